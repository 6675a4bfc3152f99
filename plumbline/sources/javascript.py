"""Tokens, brackets, loops and functions of JavaScript and TypeScript sources, JSX included.

One pass cuts a source into tokens and switches modes on the way: a template
literal's text ends at `${` and goes on after its brace, `/` begins a regular
expression where no value stands before it, `<` begins an element there if the
source closes one of that name. Brackets are paired in the same pass. Any text
is read to its end in about linear time; what does not close ends with the text.
"""

from __future__ import annotations

import bisect
import re
from functools import cached_property

WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
TOKEN = re.compile(
    rf"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[#@]?{WORD})|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<punct>=>|\?\.(?!\d)|\.\.\.|\+\+|--|&&|\|\||\?\?|[=!]==?|[<>]=|.)""",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:\\(?:.|\Z)|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", re.S)
TAG_NAME = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
CLOSING = re.compile(r"</\s*([\w$.:-]*)")
#: Type parameters before an arrow function, where an element could stand.
TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:extends\b|,|=|>\s*\()")
ATTRIBUTE = re.compile(r"""\s+|/\*.*?(?:\*/|\Z)|//[^\n]*|[A-Za-z_$][\w$.:-]*|"[^"]*"?|'[^']*'?|.""", re.S)

#: Words after which a value begins.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
#: Words whose bracket is a head, not a value.
HEADED = frozenset("if while for with switch catch".split())
OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}
ARRAY_METHODS = frozenset("forEach map filter reduce find findIndex some every flatMap".split())


class Source:
    """A source's tokens (`kinds`, `starts`, `ends`), the partner of each bracket, and what is made of them.

    Kinds: name, number, string, template (a piece of its text), regex, text (between tags), tag and punct.
    """

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.partner: dict[int, int] = {}
        self.blanks: list[tuple[int, int, bool]] = []  # what is no code; whether it is a comment, expression or markup
        self._stack: list[tuple[str, int, bool]] = []  # bracket or mode, token, whether a value ends with it
        self._held = dict.fromkeys([*OPEN, "tag", "children"], 0)
        self._chains: dict[int, int] = {}
        self._read()

    # Reading

    def _read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        self._closes = {m[1] for m in CLOSING.finditer(text)}
        while at < n:
            mode = self._stack[-1][0] if self._stack else ""
            if mode == "tag":
                at = self._tag(at)
            elif mode == "children":
                at = self._children(at)
            else:
                at = self._code(at)

    def _put(self, kind: str, a: int, b: int) -> int:
        self.kinds.append(kind)
        self.starts.append(a)
        self.ends.append(b)
        return b

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]] if 0 <= i < len(self.kinds) else ""

    def _push(self, what: str, value: bool = False) -> None:
        self._stack.append((what, len(self.kinds) - 1, value))
        self._held[what] += 1

    def _pop(self, closer: str) -> tuple[str, int, bool] | None:
        """The bracket that a closer ends, brackets left open inside with it; None if there is none."""
        if not sum(self._held[o] for o, c in OPEN.items() if c == closer):
            return None
        while True:
            top = self._stack.pop()
            self._held[top[0]] -= 1
            if OPEN.get(top[0]) == closer:
                return top

    def _value_before(self) -> bool:
        """Whether the last token ends a value, so that `/` divides and `<` compares."""
        i = len(self.kinds) - 1
        if i < 0:
            return False
        kind, word = self.kinds[i], self.word(i)
        if kind == "name":
            return word not in BEFORE_VALUE or self.word(i - 1) in (".", "?.")
        if kind == "punct":
            return self._ends_value if word in (")", "}") else word in ("]", "++", "--")
        return True

    _ends_value = False

    def _opens_block(self) -> bool:
        """Whether a brace that comes now begins a block or a body (no value)."""
        i = len(self.kinds) - 1
        word = self.word(i)
        if i < 0 or word in (")", ";", "{", "}", "=>", ">"):
            return True
        if self.kinds[i] == "name":
            return word in ("else", "do", "try", "finally") or word not in BEFORE_VALUE
        return word == ":" and bool(self._stack) and self._stack[-1][0] == "{" and not self._stack[-1][2]

    def _code(self, at: int) -> int:
        text, c = self.text, self.text[at]
        if c == "`":
            return self._template(at + 1, at)
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*") and not self._value_before() and (m := REGEX.match(text, at)):
            self.blanks.append((at + 1, m.end(), True))
            return self._put("regex", at, m.end())
        if c == "<" and not self._value_before() and (m := TAG_NAME.match(text, at)) and not TYPE_PARAMETERS.match(text, at) and (m[1] or text[at + 1 : at + 2] == ">"):
            self._put("tag", at, m.end())
            self._push("tag")
            self._name = m[1] or ""
            return m.end()
        m = TOKEN.match(text, at)
        kind, end, word = m.lastgroup, m.end(), m[0]
        if kind == "space":
            if c == "/":
                self.blanks.append((at, end, True))
            return end
        if kind == "string":
            self.blanks.append((at + 1, end - 1 if len(word) > 1 and word[-1] == c else end, False))
        if kind != "punct":
            return self._put(kind, at, end)
        if word in ("(", "[", "{"):
            before = len(self.kinds) - 1
            value = self.word(before) not in HEADED if word == "(" else word == "[" or not self._opens_block()
            self._put(kind, at, end)
            self._push(word, value)
        elif word in (")", "]", "}"):
            top = self._pop(word)
            self._put(kind, at, end)
            self._ends_value = bool(top and top[2])
            if top:
                self.partner[top[1]] = len(self.kinds) - 1
                self.partner[len(self.kinds) - 1] = top[1]
                if top[0] == "${":
                    return self._template(end, end)
        else:
            self._put(kind, at, end)
        return end

    def _template(self, at: int, begin: int) -> int:
        """A piece of a template's text from `at`; a token that begins at `begin`."""
        m = TEMPLATE.match(self.text, at)
        end = m.end()
        stop = 2 if m[0].endswith("${") else 1 if m[0].endswith("`") else 0
        self.blanks.append((at, end - stop, False))
        self._put("template", begin, end)
        if stop == 2:
            self._put("punct", end - 1, end)
            self._push("${")
        return end

    def _tag(self, at: int) -> int:
        """Inside `<name ...`: names, strings and braces up to `>` or `/>`."""
        m = ATTRIBUTE.match(self.text, at)
        word, end = m[0], m.end()
        if word.startswith(('"', "'")):
            self.blanks.append((at + 1, max(at + 1, end - 1), False))
            return self._put("string", at, end)
        if word.startswith(("//", "/*")):
            self.blanks.append((at, end, True))
        elif word == "{":
            self._put("punct", at, end)
            self._push("{", True)
        elif word == "/" and self.text[end : end + 1] == ">":
            self._leave("tag")
            return self._put("tag", at, end + 1)
        elif word == ">":
            self._leave("tag")
            self._put("tag", at, end)
            if self._name in self._closes:
                self._push("children")
        elif word == "<":
            self._put("tag", at, end)
            self._push("tag")  # type arguments
        elif not word.isspace():
            self._put("tag", at, end)
        return end

    def _leave(self, mode: str) -> None:
        self._held[mode] -= 1
        self._stack.pop()

    def _children(self, at: int) -> int:
        """Between tags: text, braces, further tags, and the tag that closes."""
        text = self.text
        if text[at] == "{":
            self._put("punct", at, at + 1)
            self._push("{", True)
            return at + 1
        if text[at] == "<":
            if text[at + 1 : at + 2] == "/":
                end = text.find(">", at) + 1 or len(text)
                self._leave("children")
                return self._put("tag", at, end)
            m = TAG_NAME.match(text, at)
            self._put("tag", at, m.end())
            self._push("tag")
            self._name = m[1] or ""
            return m.end()
        end = min((p for p in (text.find("{", at, at + 4096), text.find("<", at, at + 4096)) if p >= 0), default=min(at + 4096, len(text)))
        self.blanks.append((at, end, True))
        return self._put("text", at, end)

    # What is made of the tokens

    def masked(self, strings: bool = True) -> str:
        """The source with comments, regular expressions and text between tags (and the insides of strings and templates) as spaces; lines stay."""
        out, done = [], 0
        for a, b, always in sorted(self.blanks):
            if (always or strings) and b > a >= done:
                out += [self.text[done:a], re.sub(r"[^\n]", " ", self.text[a:b])]
                done = b
        return "".join([*out, self.text[done:]])

    @cached_property
    def newlines(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.newlines, at) + 1

    def after(self, i: int) -> int:
        """The token after the bracket that closes bracket `i`; the number of tokens if none does."""
        return self.partner.get(i, len(self.kinds) - 1) + 1

    def end(self, i: int) -> int:
        """Where token `i` ends; the text's end beyond the last one."""
        return self.ends[i] if i < len(self.ends) else len(self.text)

    def is_key_word(self, i: int) -> bool:
        """Whether a name is the language's word there, and no property."""
        return self.word(i - 1) not in (".", "?.") and self.word(i + 1) != ":"

    def statement_end(self, i: int, known: dict[int, int]) -> int:
        """The last token of the statement that begins at `i`: a semicolon, a line's end where one can stand, or the last before a closing bracket."""
        n = len(self.kinds)
        if i in known:
            return known[i]
        while i < n:
            word = self.word(i)
            if word == ";":
                return i
            if self.kinds[i] == "punct" and word in ("(", "[", "{"):
                i = self.after(i) - 1
            elif self.kinds[i] == "punct" and word in (")", "]", "}"):
                return i - 1
            if i + 1 < n and self.kinds[i + 1] in ("name", "string", "number", "tag") and (self.kinds[i] != "punct" or word in (")", "]", "}", "++", "--") or i in self.partner) and "\n" in self.text[self.ends[i] : self.starts[i + 1]]:
                if self.word(i + 1) not in ("in", "of", "instanceof") and not (self.kinds[i] == "name" and word in BEFORE_VALUE):
                    return i
            i += 1
        return n - 1

    @cached_property
    def loops(self) -> list[tuple[int, int, str, int]]:
        """Where each loop begins and ends, its word (for, while, do or the array method) and the token of that word; calls of array methods count from the begin of the value they are called on."""
        out, ends, tails = {}, {}, set()
        for i in range(len(self.kinds) - 1, -1, -1):  # inner loops first
            if self.kinds[i] != "name":
                continue
            word = self.word(i)
            if word in ("for", "while") and self.is_key_word(i):
                head = i + 1 + (self.word(i + 1) == "await")
                if self.word(head) == "(":
                    ends[i] = self._body_end(self.after(head), ends)
                    out[i] = (self.starts[i], self.end(ends[i]), word, i)
            elif word == "do" and self.is_key_word(i):
                last = self._body_end(i + 1, ends)
                if self.word(last + 1) == "while":
                    tails.add(last + 1)
                    last = self.after(last + 2) - 1
                ends[i] = last
                out[i] = (self.starts[i], self.end(last), word, i)
        for i, kind in enumerate(self.kinds):
            if kind == "name" and self.word(i - 1) == "." and self.word(i) in ARRAY_METHODS and (call := self.call_after(i)) is not None:
                out[i] = (self.starts[self.chain_start(i - 1)], self.end(self.after(call) - 1), self.word(i), i)
        return sorted((x for i, x in out.items() if i not in tails), key=lambda x: (x[0], -x[1]))

    def _body_end(self, i: int, ends: dict[int, int]) -> int:
        return self.after(i) - 1 if self.word(i) == "{" else self.statement_end(i, ends)

    def call_after(self, i: int) -> int | None:
        """The bracket of a call right after name `i`, type arguments between them or not."""
        j = i + 1
        if self.word(j) == "<":
            depth = 0
            for j in range(j, min(j + 64, len(self.kinds))):
                depth += {"<": 1, ">": -1}.get(self.word(j), 0)
                if not depth:
                    break
            j += 1
        return j if self.word(j) == "(" and self.kinds[j] == "punct" else None

    def chain_start(self, dot: int) -> int:
        """The first token of the value that ends before the dot at token `dot`: names, calls, indexes and their dots."""
        i, passed = dot, []
        while i > 0 and self.word(i) in (".", "?.", "!"):
            if i in self._chains:
                i = self._chains[i]
                break
            passed.append(i)
            i -= 1
            while self.kinds[i] == "punct" and self.word(i) in (")", "]") and i in self.partner:
                i = self.partner[i]
                if i and (self.kinds[i - 1] == "name" and self.word(i - 1) not in BEFORE_VALUE | HEADED or self.word(i - 1) in (")", "]")):
                    i -= 1
                else:
                    break
            while i and self.kinds[i] == "template" and self.word(i)[:1] != "`" and i - 1 in self.partner:
                i = self.partner[i - 1] - 1
            if i and self.word(i - 1) in (".", "?.", "!"):
                i -= 1
            elif self.word(i - 1) == "new":
                i -= 1
                break
            else:
                break
        self._chains.update(dict.fromkeys(passed, i))
        return i

    @cached_property
    def functions(self) -> list[tuple[int, int]]:
        """Where the bodies of functions, methods and arrows with braces begin (with their heads) and end."""
        out = []
        for i, kind in enumerate(self.kinds):
            if kind != "punct":
                continue
            word = self.word(i)
            if word == "=>" and self.word(i + 1) == "{":
                out.append((self.starts[i], self.end(self.after(i + 1) - 1)))
            elif word == "(" and i and (self.kinds[i - 1] == "name" and self.word(i - 1) not in HEADED or self.word(i - 1) in ("*", ">", "]") or self.kinds[i - 1] == "string"):
                body = self._body(self.after(i))
                if body is not None:
                    out.append((self.starts[i - 1], self.end(self.after(body) - 1)))
        return sorted(out)

    def _body(self, i: int) -> int | None:
        """The brace of a body after a head, over a return type of some tokens."""
        if self.word(i) == "{":
            return i
        if self.word(i) != ":" or self.kinds[i + 1 : i + 2] != ["name"]:
            return None
        for j in range(i + 2, min(i + 40, len(self.kinds))):
            word = self.word(j)
            if word == "{":
                return j if self.word(j - 1) not in ("|", "&", ":", "<", ",") else None
            if word in (";", "=>", "=", ")", "}", "?") or "\n" in self.text[self.ends[j - 1] : self.starts[j]]:
                return None
        return None


def depth_at(spans: list[tuple[int, int]]):
    """How many spans hold a position, their begin included and their end not."""
    starts, ends = sorted(a for a, *_ in spans), sorted(b for _, b, *_ in spans)
    return lambda at: bisect.bisect_right(starts, at) - bisect.bisect_right(ends, at)

