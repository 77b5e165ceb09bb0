"""Token patterns of the four languages.

One pattern a language, total and lossless: the matches of a text join to the
text.  All repetitions are possessive, so no text makes a matcher recurse.  The
same patterns run in the JVM (``token_pattern``, for ``regexp_extract_all``) and
in the parsers (``KIND_PATTERNS``).
"""

from __future__ import annotations

import re

LANGUAGES = ("python", "javascript", "java", "go")

_NAME = r"[^\W\d]\w*+"
_DOUBLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_BLOCK_COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]++|\d[\d_]*+(?:\.(?!\.)[\d_]*+)?+(?:[eE][+-]?+\d++)?+|\.\d[\d_]*+(?:[eE][+-]?+\d++)?+)[a-zA-Z]*+"
_WS, _NL = r"[ \t\f\r\x0b]++|\\\r?+\n", r"\n"


def _triple(q: str) -> str:
    return rf"{q}{q}{q}[^{q}\\]*+(?:(?:\\(?s:.)|{q}(?!{q}{q}))[^{q}\\]*+)*+{q}{q}{q}"


_PARTS = {
    "python": {
        "comment": r"#[^\n]*+",
        "string": rf"(?:[rRbBuUfFtT]{{1,2}})?+(?:{_triple(chr(34))}|{_triple(chr(39))}|{_DOUBLE}|{_SINGLE})",
        "number": _NUMBER,
        "op": r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^]=",
    },
    "javascript": {
        "comment": rf"//[^\n]*+|{_BLOCK_COMMENT}",
        "string": rf"{_DOUBLE}|{_SINGLE}|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`",
        "number": _NUMBER,
        "regex": r"/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+",
        "op": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|>>|[-+*/%&|^]=",
    },
    "java": {
        "comment": rf"//[^\n]*+|{_BLOCK_COMMENT}",
        "string": rf"{_triple(chr(34))}|{_DOUBLE}|{_SINGLE}",
        "number": _NUMBER,
        "op": r"<<=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<|[-+*/%&|^]=",
    },
    "go": {
        "comment": rf"//[^\n]*+|{_BLOCK_COMMENT}",
        "string": rf"{_DOUBLE}|`[^`]*+`|{_SINGLE}",
        "number": _NUMBER,
        "op": r"&\^=|<<=|>>=|\.\.\.|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|&\^|[-+*/%&|^]=",
    },
}
_NAMES = {"python": _NAME, "javascript": r"[#@]?+(?:[^\W\d]|\$)(?:\w|\$)*+", "java": r"(?:[^\W\d]|\$)(?:\w|\$)*+", "go": _NAME}


def _pattern(language: str, groups: bool) -> str:
    parts = _PARTS[language]
    order = [("comment", parts["comment"]), ("string", parts["string"]), ("number", parts["number"]), ("name", _NAMES[language])]
    if "regex" in parts:
        # Behind what can't end an operand; the parsers look at the token before instead.
        order.append(("regex", parts["regex"] if groups else rf"(?<=[(,=:\[!&|?{{}};\n]|[(,=:\[!&|?{{}};] )(?:{parts['regex']})"))
    order += [("nl", _NL), ("ws", _WS), ("op", parts["op"] + r"|(?s:.)")]
    return "|".join(f"(?P<{k}>{v})" if groups else f"(?:{v})" for k, v in order)


#: Compiled patterns whose groups name a token's kind.
KIND_PATTERNS = {x: re.compile(_pattern(x, True)) for x in LANGUAGES}


def token_pattern(language: str) -> str:
    """The language's token pattern for the JVM."""
    return "(?U)" + _pattern(language, False)


def comment_pattern(language: str) -> str:
    """What a whole comment token matches, for the JVM."""
    return rf"^(?:{_PARTS[language]['comment']})$"
