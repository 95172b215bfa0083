"""What the end of a text says about whether it was cut: ending evidence by light scanning.

`ending(text)` reads the whole text once with a scanner for its kind (Python, brace
languages, JSON, style sheets, prose) and names what stands at its end. It judges nothing:
how likely each kind of end is in cut and in whole texts is estimated from the data (see
`truncation`).
"""

from __future__ import annotations

import re

#: Marks that sources put where they cut; three dots alone may also end a whole text.
MARK = re.compile(r"[\[(<{]+\s*(?:!--)?\s*(?:\.\.\.|…|cut|snip|truncated?|output truncated|content truncated|text truncated|trimmed|clipped|more|continued|(?:\+?\d+ (?:more )?(?:chars?|characters|bytes|lines)[^\])>}]*))\s*(?:--)?\s*[\])>}]+|(?:-{2,}|={2,}|\*{2,})\s*(?:cut|snip|truncated?|more)\s*(?:-{2,}|={2,}|\*{2,})", re.I)
_MARK_LINE = re.compile(r"[-=*]{2,}[^-=*\n]*[-=*]{2,}$")
#: Kinds of end. The unfinished ones leave a construct open; the doubtful ones may end whole texts too.
UNFINISHED = ("mark", "string", "comment", "bracket", "block", "word", "sentence", "statement")
DOUBTFUL = ("dots", "heading", "item", "short", "odd", "newline", "note", "plain", "import")
FINISHED = "none"

#: Strings and comments of each kind; each is closed, or runs to the end of its line or of the text.
_LINE_STRINGS = r'"(?:[^"\\\n]|\\.)*(?:"|\\?\Z|(?=\n))'
_LINE_QUOTES = r"'(?:[^'\\\n]|\\.)*(?:'|\\?\Z|(?=\n))"
_BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\Z)"
_LAYERS = {
    "python": re.compile(r'#[^\n]*|"""[\s\S]*?(?:"""|\Z)|' + r"'''[\s\S]*?(?:'''|\Z)|" + _LINE_STRINGS + "|" + _LINE_QUOTES),
    "brace": re.compile(r"//[^\n]*|" + _BLOCK_COMMENT + r"|`[^`]*(?:`|\Z)|" + _LINE_STRINGS + r"|'(?:\\.|[^'\\\n])'"),
    "script": re.compile(r"//[^\n]*|" + _BLOCK_COMMENT + r"|`[^`]*(?:`|\Z)|" + _LINE_STRINGS + "|" + _LINE_QUOTES),
    "style": re.compile(_BLOCK_COMMENT + "|" + _LINE_STRINGS),
    "json": re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)'),
}
_PAIR = {")": "(", "]": "[", "}": "{"}
_NOT_BRACKETS = re.compile(r"[^()\[\]{}]+")
_NOT_JSON_BRACKETS = re.compile(r"[^\[\]{}]+")

#: Strings whose number tells the kind of content.
_SIGNS = {
    "python": ("\ndef ", "):\n", ":\n    ", " = [\n", " = {\n", "\nimport ", "\nfrom ", "\nclass ", " in range(", "log.info("),
    "go": ("\nfunc ", " := ", "package ", "\n\treturn ", "\nvar ", "\n\t\""),
    "rust": ("\nfn ", "pub fn ", "let mut ", "    let ", "impl ", "-> ", "\nstatic ", "use crate"),
    "c": ("#include", "\nstatic ", "    long ", "    int ", "(const ", "#define ", "struct "),
    "script": ("function", "const ", "let ", "var ", "=> ", "export ", "module.exports", "return{"),
    "style": ("px;", ": #", "{\n  ", "}\n\n.", "}.", "margin", "padding"),
}
_JSON_HEAD = re.compile(r'\s*[\[{]\s*(?:["\[{\]}]|-?\d|\Z|true|false|null)')
_WORD_END = re.compile(r"[A-Za-z0-9_]+$")


def kind_of(text: str) -> str:
    """The kind of content, by what stands in it; the file's name may be wrong."""
    if _JSON_HEAD.match(text):
        return "json"
    counts = {k: sum(map(text.count, signs)) for k, signs in _SIGNS.items()}
    ended, opened = text.count(";\n") + text.count(";}") + text.endswith(";"), text.count(":\n")
    if ended > opened:
        counts["python"] = 0
    elif opened > 2 * ended + text.count("{\n"):
        counts = {"python": counts["python"] + 1}
    best = max(counts, key=counts.get)
    n = len(text)
    prose = text.count(". ") + text.count(".\n") + 3 * (text.count("\n#") + text.count("\n- ") + text.count("\n| "))
    code = text.count("(") + text.count("{") + text.count("=") + text.count(";")
    if counts[best] == 0 or code * 60 < n and counts[best] * 300 < n and prose >= counts[best]:
        return "prose"
    return best


def _scan(text: str, kind: str) -> tuple[str, str | None, str, int]:
    """(brackets left open, what is open at the end, the last string or comment, where it ends)."""
    parts, at, last = [], 0, None
    for m in _LAYERS.get(kind, _LAYERS["brace"]).finditer(text):
        parts.append(text[at : m.start()])
        at, last = m.end(), m
    parts.append(text[at:])
    token = last.group() if last else ""
    if last and at == len(text):
        c = token[0]
        if token.startswith("/*"):
            if not token.endswith("*/") or len(token) < 4:
                return "", "comment", token, at
        elif token.startswith(('"""', "'''")) and kind == "python":
            if not token.endswith(token[:3]) or len(token) < 6:
                return "", "string", token, at
        elif c in "\"'`" and (len(token) < 2 or token[-1] != c or c != "`" and (len(token) - 1 - len(token[:-1].rstrip("\\"))) % 2):
            return "", "string", token, at
    brackets = (_NOT_JSON_BRACKETS if kind == "json" else _NOT_BRACKETS).sub("", "".join(parts))
    while True:
        less = brackets.replace("()", "").replace("[]", "").replace("{}", "")
        if len(less) == len(brackets):
            break
        brackets = less
    stack: list[str] = []
    for c in brackets:
        if c in "([{":
            stack.append(c)
        elif _PAIR[c] in stack:  # an outer one closes: what is inside was never meant as a bracket
            while stack.pop() != _PAIR[c]:
                pass
    return "".join(stack), None, token, at


_COMPLETE_TAIL = re.compile(r"[.!?:;\"'`)\]}>*_|~…]$")
_LISTED = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")
_DANGLING = re.compile(r"(?:[=+\-*/%<>&|^~,.:(\[{\\@]|\b(?:and|or|not|in|is|if|elif|else|for|while|with|as|def|class|import|from|lambda|yield|raise|assert|global|del|except|finally|try|await|async))$")
_KEYWORDS = frozenset("break continue pass return None True False else try finally yield raise".split())


_CODE_LINE = re.compile(r"(?:^|\s)(?:return|break|pass|end|continue)(?:\s+\w+)?;?$", re.I)
_FUNCTION_WORD = re.compile(r"(?:^|\s)(?:a|an|the|of|in|on|at|to|by|for|from|with|without|and|or|but|nor|near|over|under|behind|between|before|after|until|across|beside|below|above|any|each|every|some|this|that|these|those|another|one|is|are|was|were|has|have|its|their|as|than|which|who|where|when|while|if|because|so|not)$", re.I)


def _sentence(line: str) -> str | None:
    """`sentence` for the text of a comment or paragraph without an end, else None."""
    line = line.rstrip()
    if not line or line.endswith("*/") or _COMPLETE_TAIL.search(line) or _CODE_LINE.search(line):
        return None
    return "sentence"


def _prose(text: str) -> str | None:
    body = text.rstrip()
    if (body.startswith("```") + body.count("\n```")) % 2:
        return "block"
    lines = body.split("\n")
    line = lines[-1].strip()
    if line.startswith("|") and not line.endswith("|"):
        return "block"
    if re.match(r"#{1,6}\s|\||```|={3,}|-{3,}|\[[^\]]*\]\([^)]*\)$", line):
        return "heading" if line.startswith("#") else None
    start = len(lines) - 1
    while start > 0 and lines[start - 1].strip() and not re.match(r"\s*(?:#{1,6}\s|\||```)", lines[start - 1]) and not _LISTED.match(lines[start]):
        start -= 1
    paragraph = " ".join(x.strip() for x in lines[start:])
    if _sentence(paragraph) is None:
        return None
    if _LISTED.match(lines[start]):
        return "item"
    if _FUNCTION_WORD.search(paragraph):
        return "sentence"
    if not re.fullmatch(r"[\w ,;:'’()%/.!?*&\[\]\"-]+", line) or re.search(r"[=(){}\[\]]", line):
        if text.endswith(("\n", "\r")):
            return "odd"  # as code wrapped like prose may end
        # Rows of data or code among prose: what the last line leaves open counts as in code.
        stack, open_, _, _ = _scan(line, "brace")
        return open_ or ("bracket" if stack else "odd")
    if text.endswith("\n"):
        return "newline"
    if len(paragraph.split()) <= 6 and len(lines) - start == 1 and (start == 0 or not lines[start - 1].strip()):
        return "short"  # as a heading or signature of its own would be
    return "sentence"


def _comment_line(body: str, line: str, sign: str) -> str | None:
    """For a last line that is a comment; code or a wrapped block behind comment signs says nothing."""
    before = body[: len(body) - len(line)].rstrip().rsplit("\n", 1)[-1].strip()
    text = line.strip().lstrip(f"{sign} \t")
    if before.startswith(sign) and not text[:1].isupper():
        return None if not _FUNCTION_WORD.search(text) else _sentence(text)
    return _sentence(text)


def _trailing_comment(last: str, sign: str) -> str | None:
    """For a comment behind code: a note without a stop is common, so only a function word at its end is strong."""
    text = last.lstrip(f"{sign} \t")
    found = _sentence(text)
    return found if found is None or _FUNCTION_WORD.search(text) else "note"


def _python(text: str) -> str | None:
    body = text.rstrip()
    stack, open_, last, at = _scan(body, "python")
    if open_:
        return open_
    if stack:
        return "bracket"
    line = body[body.rfind("\n") + 1 :]
    bare = line.strip()
    if bare.startswith("#"):
        return _comment_line(body, line, "#")
    if last.startswith("#") and at == len(body):
        return _trailing_comment(last, "#")
    if bare.endswith(":"):
        return "block"
    if _DANGLING.search(bare):
        return "statement"
    m = _WORD_END.search(bare)
    if m and not bare[: m.start()].endswith(('"', "'")):
        word = m.group()
        if word == bare:
            return None if word in _KEYWORDS else "word"
        if word not in _KEYWORDS and not word.isdigit() and not bare.startswith(("import", "from")):
            if not re.search(rf"\b{re.escape(word)}\b", body[: len(body) - len(word)]):
                return "word" if not text.endswith("\n") else "newline"
    return None


def _brace(text: str, kind: str) -> str | None:
    body = text.rstrip()
    stack, open_, last, at = _scan(body, kind if kind in _LAYERS else "brace")
    if open_:
        return open_
    if stack:
        return "block" if stack[-1] == "{" else "bracket"
    line = body[body.rfind("\n") + 1 :]
    bare = line.strip()
    if bare.startswith("//"):
        return _comment_line(body, line, "//")
    if last.startswith("//") and at == len(body):
        return _trailing_comment(last, "//")
    if kind == "json":
        return None if body[-1:] in "}]\"" or re.search(r"(?:\d|true|false|null)$", body) else "statement"
    if body.endswith(("}", ";", "*/", ")", "]")) or bare.startswith("#"):
        return None
    if _CODE_LINE.search(bare):
        return "plain"
    if text.endswith("\n"):
        return "newline"
    if kind == "go" and re.match(r"(?:package|import|var|const|type)\b.*[\w\"`]$", bare):
        return "import"
    if kind == "script" and re.match(r"(?:export default|module\.exports|import .* from|const|let|var)\b.*[\w'\"`]$", bare):
        return "import"
    return "statement"


def _marked(body: str) -> bool:
    """Whether the text ends in a mark put there by a source, however long that is."""
    if body[-1] in "])>}":
        begin = max(body.rfind(c) for c in "[(<{")
        while begin > 0 and body[begin - 1] in "[(<{":
            begin -= 1
        return begin >= 0 and MARK.fullmatch(body, begin) is not None
    if body[-1] in "-=*":
        found = _MARK_LINE.search(body, body.rfind("\n") + 1)
        return found is not None and MARK.fullmatch(body, found.start()) is not None
    return False


def ending(text: str | None) -> str:
    """How text ends: one of UNFINISHED or DOUBTFUL, or FINISHED; a blank or null one is finished."""
    if text is None or not text.strip():
        return FINISHED
    body = text.rstrip()
    if _marked(body):
        return "mark"
    if body[-1] == "\ufffd":
        return "word"
    bare = body.rstrip(".…")
    dots = len(body) - len(bare) >= 3 or "…" in body[len(bare) :]
    if dots and not bare.strip():
        return FINISHED
    seen = bare if dots else text
    kind = kind_of(bare if dots else body)
    found = _prose(seen) if kind == "prose" else _python(seen) if kind == "python" else _brace(seen, kind)
    if dots:
        return found if found in UNFINISHED and found not in ("sentence", "word") else "dots"
    if found in ("sentence", "word", "statement") and text.endswith(("\n", "\r")):
        return "newline"  # a cut seldom falls just behind a line end
    return found or FINISHED
