"""Rule regexes are written in the ECMAScript dialect; Spark runs them on Java.

Only the differences that change results are handled: ``\\b`` is Unicode-aware
on JVM 17, ``\\s`` is ASCII-only there, and ``i`` without ``u`` folds ASCII only
when the pattern itself is ASCII.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
# ECMAScript white space and line terminators, as class members.
JS_SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_W = "[A-Za-z0-9_]"
ASCII_BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
ASCII_NOT_BOUNDARY = f"(?:(?<!{_W})(?!{_W})|(?<={_W})(?={_W}))"

# Marks for one-pass match extraction.  Unicode noncharacters are reserved for
# internal use; a text that does hold one is translated (length kept) first.
MATCH_MARK = chr(0xFDD0)
FIELD_MARK = chr(0xFDD1)
MARK_STAND_IN = chr(0xFDD2)


def escape(value: str) -> str:
    """Quote every regex metacharacter (``\\Q..\\E`` would break on ``\\E``)."""
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m.group(0), value)


def escape_class(chars: str) -> str:
    """Members of a character class."""
    return "".join("\\" + c if c in "\\[]^-&" else c for c in chars)


def escape_replacement(text: str) -> str:
    return unmark(text).replace("\\", "\\\\").replace("$", "\\$")


def unmark(text: str) -> str:
    return text.replace(MATCH_MARK, MARK_STAND_IN).replace(FIELD_MARK, MARK_STAND_IN)


# A leading ``\\b`` before something that must start with a word character is just
# "no word character before"; Java tests that far faster than the full boundary.
_WORD_START = re.compile(
    r"\\b(?=[A-Za-z0-9_]|\[[A-Za-z0-9_-]*[A-Za-z0-9_]\]|\(\?:[A-Za-z0-9_][A-Za-z0-9_|]*\)"
    r"|\(\?:[A-Za-z0-9_]|\(\?![A-Za-z0-9_|\[\]{}-]*\)\[[0-9-]*\])"
)
_PLAIN_LOOKBEHIND = re.compile(r"\(\?<=(?:[^()\\]|\\.|\(\?:[^()]*\))*?(\[[^\]\\]*\]|[A-Za-z0-9/:@#=_-])\)")


def _word_led(source: str) -> bool:
    m = _WORD_START.match(source)
    if not m:
        return False
    rest = source[2:]
    if rest.startswith("(?:"):
        body = rest[3 : rest.index(")")] if "(" not in rest[3 : rest.index(")")] else None
        return body is not None and all(re.match(r"[A-Za-z0-9_]", x) for x in body.split("|"))
    return True


def to_java(source: str) -> str:
    """Rewrite the escapes whose meaning differs on the JVM."""
    out, in_class, i = [], False, 0
    if _word_led(source):
        out.append(f"(?<!{_W})")
        i = 2
    else:
        # Test the last character of a leading lookbehind before its whole body.
        behind = _PLAIN_LOOKBEHIND.match(source)
        if behind:
            out.append(f"(?<={behind.group(1)})")
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            pair = source[i : i + 2]
            if pair == "\\s":
                out.append(JS_SPACE if in_class else f"[{JS_SPACE}]")
            elif pair == "\\S" and not in_class:
                out.append(f"[^{JS_SPACE}]")
            elif pair == "\\b" and not in_class:
                out.append(ASCII_BOUNDARY)
            elif pair == "\\B" and not in_class:
                out.append(ASCII_NOT_BOUNDARY)
            elif pair == "\\b":
                out.append("\\x08")
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and in_class:
            out.append("\\[")  # a nested class in Java, a plain bracket in ECMAScript
        elif c == "&" and in_class and source[i : i + 2] == "&&":
            out.append("\\&")
        else:
            if c == "[":
                in_class = True
            elif c == "]":
                in_class = False
            out.append(c)
        i += 1
    return "".join(out)


def count_groups(source: str) -> int:
    """Capturing groups of a regex, named ones included."""
    n, in_class, i = 0, False, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class:
            tail = source[i + 1 : i + 4]
            if not tail.startswith("?") or (tail.startswith("?<") and tail[2:3] not in ("=", "!")):
                n += 1
        i += 1
    return n


def folded(source: str, insensitive: bool) -> str:
    """Scope the case flag the way ``i`` without ``u`` folds."""
    if not insensitive:
        return source
    return f"(?i:{source})" if source.isascii() else f"(?iu:{source})"


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalpha() or ch.isnumeric()


def is_word_token(value: str) -> bool:
    """Only a value made entirely of word characters can hide in a longer word."""
    return value != "" and all(map(_is_word, value))


def guards(value: str) -> tuple[str, str]:
    """Edge guards: a non-word neighbour, or another copy of the value itself."""
    me = escape(value)
    pre = f"(?:(?<!{WORD})|(?<={me}))" if _is_word(value[0]) else ""
    post = f"(?:(?!{WORD})|(?={me}))" if _is_word(value[-1]) else ""
    return pre, post


def literal_source(value: str, boundary: bool) -> str:
    pre, post = guards(value) if boundary else ("", "")
    return f"(?iu:{pre}{escape(value)}{post})"


def js_template(replace: str, groups: int) -> str:
    """An ECMAScript-style ``$1`` template as a Java replacement string."""
    out, i = [], 0
    while i < len(replace):
        if replace[i] == "$" and i + 1 < len(replace) and replace[i + 1].isdigit():
            n = int(replace[i + 1])
            i += 2
            if n <= groups:
                out.append(f"${n}")
                if i < len(replace) and replace[i].isdigit():
                    out.append("\\" + replace[i])
                    i += 1
            continue
        out.append(escape_replacement(replace[i]))
        i += 1
    return "".join(out)
