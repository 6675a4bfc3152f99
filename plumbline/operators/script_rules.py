"""Detectors over the tokens and scopes of JavaScript and TypeScript: one source text -> many findings.

Calls, their arguments and the properties of object arguments are found on
tokens, so text in strings, templates, regular expressions, comments and markup
is never taken for code, while code in `${...}` and in braces of markup is.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

from ..sources.javascript import BEFORE_VALUE, HEADED, Source, depth_at

Finding = tuple[int, str, str, str]  # line, rule, severity, detail

STATEMENTS = frozenset(("for", "while", "do"))


class Call(NamedTuple):
    """A call: the token of its last name, its bracket, and whether a dot or a question dot comes before the name, or `new` before the value."""

    name: str
    at: int
    paren: int
    member: bool
    optional: bool
    new: bool


class Script(Source):
    """A source with its calls; positions are of tokens unless said otherwise."""

    @cached_property
    def calls(self) -> list[Call]:
        heads = {a for a, _ in self.functions}
        out = []
        for i, kind in enumerate(self.kinds):
            if kind != "name" or self.starts[i] in heads and self.word(i - 1) != "=>":
                continue
            word, before = self.word(i), self.word(i - 1)
            member = before in (".", "?.")
            if not member and (word in HEADED or word in BEFORE_VALUE or word in ("function", "async", "super", "import")) or before == "function":
                continue
            paren = i + 2 if self.word(i + 1) == "?." and self.word(i + 2) == "(" else self.call_after(i)
            if paren is not None:
                start = self.chain_start(i - 1) if member else i - (before == "new")
                out.append(Call(word, i, paren, before == ".", before == "?." or paren == i + 2, self.word(start) == "new"))
        return out

    def items(self, opener: int) -> list[tuple[int, int]]:
        """First and last token of each item between a bracket and its partner, cut at commas; none if it is not closed."""
        if opener not in self.partner:
            return []
        end, out, i = self.after(opener) - 1, [], opener + 1
        a = i
        while i < end:
            if self.kinds[i] == "punct" and self.word(i) == ",":
                out.append((a, i - 1))
                a = i + 1
            i = self.partner[i] if i in self.partner and self.partner[i] > i else i
            i += 1
        if a < end:
            out.append((a, end - 1))
        return [(a, b) for a, b in out if b >= a]

    def properties(self, brace: int) -> dict[str, tuple[int, int]]:
        """Name of each plain property of an object and the first and last token of its value; shorthand counts, methods and spreads do not."""
        out = {}
        for a, b in self.items(brace):
            key = self.word(a).strip("'\"")
            if self.word(a + 1) == ":" and a + 1 < b:
                out[key] = (a + 2, b)
            elif a == b and self.kinds[a] == "name":
                out[key] = (a, b)
        return out

    def is_object(self, item: tuple[int, int]) -> bool:
        return self.word(item[0]) == "{" and self.partner.get(item[0]) == item[1]

    def line_of(self, call: Call) -> int:
        """The line where the call's value begins."""
        return self.line(self.starts[self.chain_start(call.at - 1) if call.member or call.optional else call.at - call.new])

    def text_of(self, a: int, b: int) -> str:
        """A string's or template's text, code in it as `${}`."""
        if self.kinds[a] == "string":
            return self.word(a)[1:-1]
        out, i = [], a
        while i <= b:
            if self.kinds[i] == "template":
                word = self.word(i)
                out.append(word[1 if i == a else 0 : -2 if word.endswith("${") else -1])
            elif i in self.partner and self.partner[i] > i:
                i = self.partner[i]
            i += 1
        return "${}".join(out)

    def path(self, a: int, b: int) -> str:
        """A value of names, indexes and calls as `a.b()`; another is `<expr>`."""
        if a > b or self.kinds[a] not in ("name", "string") or self.word(a) in BEFORE_VALUE | {"function", "async"}:
            return "<expr>"
        out, i = self.word(a) if self.kinds[a] == "name" else self.text_of(a, a), a + 1
        while i <= b:
            word = self.word(i)
            if word == "." and i < b and self.kinds[i + 1] == "name":
                out, i = f"{out}.{self.word(i + 1)}", i + 2
            elif word in ("(", "[") and i in self.partner and self.partner[i] <= b:
                end = self.partner[i]
                out, i = out + ("()" if word == "(" else f".{self.path(i + 1, end - 1)}"), end + 1
            else:
                return "<expr>"
        return out

    def owner(self, call: Call) -> str:
        """The path of what a call's last name belongs to."""
        return self.path(self.chain_start(call.at - 1), call.at - 2) if call.member else ""

    @cached_property
    def loop_depth(self):
        """How many loops hold a position, calls of array methods among them."""
        return depth_at(self.loops)

    def nearest(self, places: list[int], spans: list[tuple[int, int]]) -> dict[int, int]:
        """Where the last span to begin that holds each position begins; -1 for none."""
        waiting, held, out, k = sorted(spans), [], {}, 0
        for at in sorted(places):
            while k < len(waiting) and waiting[k][0] <= at:
                heapq.heappush(held, (-waiting[k][0], waiting[k][1]))
                k += 1
            while held and held[0][1] <= at:
                heapq.heappop(held)
            out[at] = -held[0][0] if held else -1
        return out

    @cached_property
    def own_functions(self) -> list[tuple[int, int]]:
        """Functions but for those given to array methods, which run once an element."""
        given = {self.starts[a]: self.ends[b] for _, _, word, i in self.loops if word not in STATEMENTS and (p := self.call_after(i)) for a, b in self.items(p)}
        starts, out = sorted(given), []
        for a, b in self.functions:
            k = bisect.bisect_right(starts, a) - 1
            if k < 0 or given[starts[k]] != b:
                out.append((a, b))
        return out

    def in_loops(self, places: list[int]) -> set[int]:
        """The positions that a loop holds more closely than a function of its own."""
        loop, own = self.nearest(places, [(a, b) for a, b, *_ in self.loops]), self.nearest(places, self.own_functions)
        return {p for p in places if loop[p] >= 0 and loop[p] > own[p]}


def loop_rules(text: str) -> list[Finding]:
    """Regular expressions, JSON.parse and awaited calls in loops; loops and array methods two levels down; array methods chained on filter or map."""
    s, out = Script(text), []
    depth = s.loop_depth
    for i, kind in enumerate(s.kinds):
        if kind == "regex" and depth(s.starts[i]):
            out.append((s.line(s.starts[i]), "regex-in-loop", "high", "literal"))
        elif kind == "name" and s.word(i) == "await" and s.is_key_word(i) and s.word(i - 1) != "for" and depth(s.starts[i]) and (c := awaited_call(s, i)) is not None:
            out.append((s.line(s.starts[c]), "sequential-await-in-loop", "high", "await"))
    for start, _, word, i in s.loops:
        if word == "for" and depth(start) > 2:  # itself among them
            out.append((s.line(start), "nested-loops", "high", str(depth(start))))
    for c in s.calls:
        if c.name == "RegExp" and c.new and not c.member and depth(s.starts[c.at - 1]):
            out.append((s.line(s.starts[c.at - 1]), "regex-in-loop", "high", "new RegExp"))
        elif c.name == "parse" and c.member and s.owner(c) == "JSON" and depth(s.starts[c.at]):
            out.append((s.line_of(c), "json-parse-in-loop", "high", "JSON.parse"))
    return sorted([*out, *method_rules(s)])


def method_rules(s: Script) -> Iterator[Finding]:
    ends = {s.after(s.call_after(i)): word for *_, word, i in s.loops if word not in STATEMENTS}
    for start, _, word, i in s.loops:
        if word in STATEMENTS:
            continue
        around = s.loop_depth(s.starts[i]) - 1
        if around >= 2:
            yield s.line(start), "nested-array-methods", "medium", word
        if word in ("map", "filter", "reduce", "forEach") and ends.get(i - 1) in ("filter", "map"):
            yield s.line(start), "chained-array-methods", "medium", f"{ends[i - 1]}.{word}"


def awaited_call(s: Script, i: int) -> int | None:
    """The first token of the call that `await` at token `i` waits for; None if it waits for no call."""
    a = j = i + 1
    if s.word(j) in ("new", "") or j >= len(s.kinds):
        return None
    if s.kinds[j] == "punct":
        return None
    last = ""
    j += 1
    while j < len(s.kinds):
        word = s.word(j)
        if word in (".", "?.", "!") and j + 1 < len(s.kinds) and s.kinds[j + 1] == "name":
            last, j = "name", j + 2
        elif word in ("(", "["):
            last, j = word, s.after(j)
        elif word == "<" and (p := s.call_after(j - 1)) is not None:
            j = p
        else:
            break
    return a if last == "(" else None


def blocking_rules(text: str, families: dict[str, list[str]]) -> list[Finding]:
    """Calls that block the event loop, in a loop statement, forEach or map (`loop`) or not (`once`)."""
    s = Script(text)
    family = {m: k for k, ms in families.items() for m in ms}
    depth = depth_at([x for x in s.loops if x[2] in STATEMENTS or x[2] in ("forEach", "map")])
    return sorted((s.line_of(c), f"blocking_{family[c.name]}", "loop" if depth(s.starts[c.at]) else "once", c.name) for c in s.calls if c.name in family and not c.new and not c.optional)


#: Reads that force a layout, and look-ups of elements.
LAYOUT_READS = frozenset(
    """offsetWidth offsetHeight offsetTop offsetLeft offsetParent clientWidth clientHeight clientTop clientLeft scrollWidth scrollHeight scrollTop scrollLeft
    getBoundingClientRect getClientRects getComputedStyle innerWidth innerHeight scrollY scrollX pageYOffset pageXOffset""".split()
)
DOM_QUERIES = frozenset("querySelector querySelectorAll getElementById getElementsByClassName getElementsByTagName getElementsByName closest matches".split())


def dom_rules(text: str) -> list[Finding]:
    """Layout reads, markup and style writes and element look-ups in a loop."""
    s, found = Script(text), []
    called = {c.at for c in s.calls}
    for i, kind in enumerate(s.kinds):
        if kind != "name" or s.word(i - 1) != ".":
            continue
        word, written = s.word(i), assigned(s, i + 1)
        if written and word in ("innerHTML", "outerHTML"):
            found.append((i, "innerhtml_in_loop", "high"))
        if written and s.word(i - 2) == "style" and s.word(i - 3) == ".":
            found.append((i, "style_mutation_in_loop", "medium"))
        if word == "style" and s.word(i + 1) == "[" and assigned(s, s.after(i + 1)):
            found.append((i, "style_mutation_in_loop", "medium"))
        if word in LAYOUT_READS and not written:
            found.append((i, "forced_sync_layout", "high"))
        if word in DOM_QUERIES and i in called:
            found.append((i, "dom_query_in_loop", "medium"))
    held = s.in_loops([s.starts[i] for i, *_ in found])
    return sorted((s.line(s.starts[s.chain_start(i - 1)]), rule, severity, s.word(i)) for i, rule, severity in found if s.starts[i] in held)


def assigned(s: Script, i: int) -> bool:
    """Whether an assignment begins at token `i`: = or an operator with it."""
    if s.word(i) == "=":
        return True
    word = s.word(i)
    return word in ("+", "-", "*", "/", "%", "&&", "||", "??", "|", "&", "^") and s.word(i + 1) == "=" and s.starts[i + 1] == s.ends[i]


SELECT_STAR = re.compile(r"SELECT\s+\*\s+FROM", re.I)


def payload_rules(text: str) -> list[Finding]:
    """Find calls whose object has no take, limit or where; objects three levels deep as first arguments; SELECT * in strings and templates."""
    s, out = Script(text), []
    for c in s.calls:
        if not c.member or c.new:
            continue
        first = next(iter(s.items(c.paren)), None)
        known = s.properties(first[0]) if first and s.is_object(first) else {}
        if c.name in ("findMany", "findFirst", "find", "findAll") and not known.keys() & {"take", "limit", "where"}:
            out.append((s.line_of(c), "unbounded_find_all", "high", c.name))
        if c.name == "include" or nesting(s, known) >= 3:
            out.append((s.line_of(c), "deep_nested_include", "medium", c.name))
    for i, kind in enumerate(s.kinds):
        if kind in ("string", "template") and SELECT_STAR.search(s.word(i)):
            out.append((s.line(s.starts[i]), "select_star", "high", "SELECT *"))
    return sorted(out)


def nesting(s: Script, known: dict[str, tuple[int, int]], depth: int = 1) -> int:
    """Levels of objects within objects, three at most."""
    inner = [s.properties(v[0]) for v in known.values() if s.is_object(v)]
    return depth if depth >= 3 or not inner else max(nesting(s, p, depth + 1) for p in inner)


#: What acquires and what releases a resource. Kind, severity, acquiring calls, releasing calls.
CLOSING = "close end destroy release disconnect dispose".split()
RESOURCES = [
    ("unclosed_connection", "high", "createConnection connect open createPool getConnection".split(), CLOSING),
    ("unclosed_stream", "high", "createReadStream createWriteStream pipe openSync".split(), "close end destroy".split()),
    ("unclosed_file_handle", "high", ["openSync"], "close closeSync".split()),
    ("unclosed_timer", "medium", "setInterval setTimeout".split(), "clearInterval clearTimeout".split()),
    ("unclosed_event_listener", "medium", "on addListener addEventListener".split(), "off removeListener removeEventListener".split()),
]
DISPOSABLE = {"WebSocket": "close", "EventSource": "close", "Worker": "terminate", "SharedWorker": "close", "BroadcastChannel": "close", "MessageChannel": "close", "AbortController": "abort"}


def resource_rules(text: str) -> list[Finding]:
    """Acquiring and releasing calls with the function they are in (its position, -1: none).

    Detail is `function:acquire:place` and `function:release`, and `function:release:place` beside for what releases the resource
    acquired at a place: a call of its kind anywhere in that function, functions within it included.
    """
    s = Script(text)
    places: dict[str, list[int]] = {}
    for c in s.calls:
        places.setdefault(c.name, []).append(s.starts[c.at])
    piped = sorted(s.starts[c.at] for c in s.calls if c.name == "pipe" and (a := s.items(c.paren)) and s.word(a[0][0]) in ("res", "response") and a[0][0] == a[0][1])
    using = sorted(s.starts[i] for i, k in enumerate(s.kinds) if k == "name" and s.word(i) == "using" and i + 1 < len(s.kinds) and s.kinds[i + 1] == "name")
    taken: list[tuple[int, str, str, int]] = []  # position, rule, severity, line
    given: dict[str, list[int]] = {}
    for rule, severity, take, give in RESOURCES:
        given[rule] = sorted(p for g in give for p in places.get(g, ()))
        for c in s.calls:
            if c.name in take and (rule != "unclosed_event_listener" or c.member):
                taken.append((s.starts[c.at], rule, severity, s.line_of(c)))
    given["unclosed_connection"] = sorted(given["unclosed_connection"] + using)
    given["unclosed_stream"] = sorted(given["unclosed_stream"] + piped)
    for c in s.calls:
        if c.new and not c.member and c.name in DISPOSABLE and s.word(c.at - 2) == "=":
            taken.append((s.starts[c.at], f"resource_without_cleanup:{c.name}", "medium", s.line(s.starts[c.at])))
            given[f"resource_without_cleanup:{c.name}"] = sorted(places.get(DISPOSABLE[c.name], ()))
    ends = dict(s.functions)
    inside = s.nearest([*(p for p, *_ in taken), *(p for ps in given.values() for p in ps)], s.functions)
    severity_of = {rule: severity for rule, severity, *_ in RESOURCES}
    out = {(s.line(p), rule.split(":")[0], severity_of.get(rule, "medium"), f"{inside[p]}:release") for rule, ps in given.items() for p in ps}
    for p, rule, severity, line in taken:
        f = inside[p]
        kind = rule.split(":")[0]
        out.add((line, kind, severity, f"{f}:acquire:{p}"))
        k = bisect.bisect_left(given[rule], f)
        if f >= 0 and k < len(given[rule]) and given[rule][k] < ends[f]:
            out.add((s.line(given[rule][k]), kind, severity, f"{f}:release:{p}"))
    return sorted(out)


#: Names of calls whose results might be cached.
DB_CALLS = frozenset("aggregate count execute find findAll findById findMany findOne findFirst findUnique query raw".split())
DB_OWNERS = ("prisma", "db", "Sequelize", "knex", "repository", "model")
GRAPHQL_CALLS, GRAPHQL_OWNERS = frozenset("query mutate watchQuery execute".split()), ("client", "apollo", "graphql")
PURE_PREFIXES = tuple("build calculate compute decode derive encode format hash normalize parse render serialize transform validate".split())


def cache_rules(text: str) -> list[Finding]:
    """Calls whose results might be cached, with a normalised signature: http, graphql, db or pure (of plain arguments only)."""
    s, out = Script(text), []
    for i, kind in enumerate(s.kinds):
        if kind == "template" and s.word(i)[:1] == "`" and i and s.kinds[i - 1] == "name" and s.word(i - 1) == "gql":
            end = template_end(s, i)
            out.append((s.line(s.starts[s.chain_start(i - 2) if s.word(i - 2) == "." else i - 1]), "graphql", signature("graphql", s.text_of(i, end).strip())))
    for c in s.calls:
        if not c.new and not c.optional and (made := call_signature(s, c)):
            out.append((s.line_of(c), *made))
    return sorted((line, rule, "medium", detail) for line, rule, detail in out)


def signature(*parts: str) -> str:
    return re.sub(r"\s+", " ", " | ".join(p for p in parts if p)).strip()


def template_end(s: Script, i: int) -> int:
    """The last token of the template that begins at token `i`."""
    while s.word(i).endswith("${") and i + 1 < len(s.kinds):
        i = s.after(i + 1)
        if i >= len(s.kinds):
            return len(s.kinds) - 1
    return i


def is_text(s: Script, item: tuple[int, int]) -> bool:
    return item[0] == item[1] and s.kinds[item[0]] == "string" or s.kinds[item[0]] == "template" and template_end(s, item[0]) == item[1]


def argument(s: Script, item: tuple[int, int]) -> str:
    """Text and numbers as they are, objects and lists as {...} and [...], names and members as paths, else <expr>."""
    a, b = item
    if is_text(s, item):
        return s.text_of(a, b)
    if s.partner.get(a) == b and s.word(a) in ("{", "["):
        return "{...}" if s.word(a) == "{" else "[...]"
    if a == b and s.kinds[a] in ("number", "name"):
        return s.word(a)
    path = s.path(a, b)
    return "<expr>" if path.endswith("()") else path


def url(s: Script, items: list[tuple[int, int]]) -> str:
    if not items:
        return "<dynamic-url>"
    a, b = items[0]
    return s.text_of(a, b) if is_text(s, items[0]) else f"<dynamic:{s.word(a)}>" if a == b and s.kinds[a] == "name" else "<dynamic-url>"


def http_method(s: Script, items: list[tuple[int, int]]) -> str:
    known = s.properties(items[1][0]) if len(items) > 1 and s.is_object(items[1]) else {}
    value = next((v for k, v in known.items() if k.lower() == "method"), None)
    return "GET" if value is None else s.text_of(*value).upper() if s.kinds[value[0]] == "string" and value[0] == value[1] else "<dynamic-method>"


def call_signature(s: Script, c: Call) -> tuple[str, str] | None:
    items, owner = s.items(c.paren), s.owner(c)
    if c.name == "fetch" and owner in ("", "window"):
        method = http_method(s, items)
        return ("http", signature("window.fetch" if owner else "fetch", url(s, items), f"method={method}")) if method in ("GET", "HEAD", "<dynamic-method>") else None
    if owner in ("axios", "http", "https"):
        return ("http", signature(owner, c.name, url(s, items))) if c.name.upper() in ("GET", "HEAD") else None
    if c.member and c.name in ("get", "head") and any(w in owner for w in ("axios", "client", "api")):
        return "http", signature("http", owner, c.name, url(s, items))
    if c.name == "gql" and not owner:
        return ("graphql", signature("graphql", s.text_of(*items[0]).strip())) if items and is_text(s, items[0]) and s.kinds[items[0][0]] == "template" else None
    if c.member and c.name in GRAPHQL_CALLS and any(w in owner for w in GRAPHQL_OWNERS):
        query = items[0] if items else None
        if query and s.is_object(query):
            query = next((v for k, v in s.properties(query[0]).items() if k in ("query", "mutation", "document")), None)
            if query and s.word(query[0]) == "gql" and query[0] < query[1]:
                query = (query[0] + 1, query[1])
        if query and is_text(s, query):
            return "graphql", signature("graphql", owner, c.name, s.text_of(*query).strip())
    if c.member and c.name in DB_CALLS and any(w in owner for w in DB_OWNERS):
        return "db", signature("db", owner, c.name, argument(s, items[0]) if items else "<unknown>")
    if not c.member and c.name.startswith(PURE_PREFIXES) and items and all((x := argument(s, i)) != "<expr>" or is_text(s, i) for i in items):
        return "pure", signature("pure_compute", c.name, ", ".join(argument(s, i) for i in items))
    return None

#: Packages whose whole import is large.
MOMENT, LODASH = {"moment", "moment-timezone"}, {"lodash", "underscore"}
BARRELS = set("@mui/material @mui/icons-material @mui/lab antd @ant-design/icons @chakra-ui/react @mantine/core @mantine/hooks @headlessui/react @heroicons/react react-bootstrap reactstrap semantic-ui-react".split())


def imports(s: Script) -> Iterator[tuple[int, str, str]]:
    """Token, what is imported, and the package of every import statement; one ends at its quoted package, a semicolon or the next import."""
    n = len(s.kinds)
    for i in range(n):
        if s.kinds[i] != "name" or s.word(i) != "import" or not s.is_key_word(i) or s.word(i + 1) in ("(", "."):
            continue
        j = i + 1
        while j < n and s.kinds[j] != "string" and s.word(j) not in (";", "import"):
            j += 1
        if j < n and s.kinds[j] == "string":
            what = s.text[s.ends[i] : s.starts[j]].strip()
            yield i, re.sub(r"^type\s+|\s*\bfrom\s*$", "", what).strip(), s.word(j)[1:-1]


def import_rules(text: str) -> list[Finding]:
    """Imports and requires of packages that bring more than is used."""
    s, out = Script(text), []
    for c in s.calls:
        items = s.items(c.paren)
        if c.name == "require" and not c.member and len(items) == 1 and is_text(s, items[0]) and s.text_of(*items[0]) in MOMENT | LODASH:
            out.append((s.line_of(c), "cjs_require", "high", s.text_of(*items[0])))
    for i, what, package in imports(s):
        line = s.line(s.starts[i])
        if package in MOMENT:
            out.append((line, "moment_import", "high", package))
        elif what.startswith("* as") and package in LODASH | BARRELS:
            out.append((line, "namespace_import", "high", package))
        elif package in LODASH:
            out.append((line, "full_lodash_import", "high", package))
        elif package in BARRELS and what.startswith("{"):
            out.append((line, "barrel_import", "medium", package))
    return sorted(out)


def query_rules(text: str) -> list[Finding]:
    """Fields of each query's where block: rule is the model, detail the fields."""
    s, out = Script(text), []
    for c in s.calls:
        owner = s.owner(c).split(".") if c.member else []
        if c.name not in ("findMany", "findFirst", "findUnique") or len(owner) < 2 or owner[-2] != "prisma":
            continue
        first = next(iter(s.items(c.paren)), None)
        where = s.properties(first[0]).get("where") if first and s.is_object(first) else None
        if where and s.is_object(where) and (fields := list(s.properties(where[0]))):
            out.append((s.line_of(c), owner[-1][0].upper() + owner[-1][1:], "high", ",".join(fields)))
    return sorted(out)
