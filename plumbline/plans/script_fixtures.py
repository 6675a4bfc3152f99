r"""Sources with findings labelled by hand, and surroundings that must not change them.

A snippet is a source and its findings (line within the snippet, rule). A
surrounding is what stands before and after it and whether the snippet is code
there; the findings move down by the lines before it, or are none in a comment or in a template's text.
"""

from __future__ import annotations

Labelled = tuple[str, list[tuple[int, str]]]

#: name -> before, after, whether the snippet is code.
AROUND: dict[str, tuple[str, str, bool]] = {
    "alone": ("", "", True),
    "function": ("async function run() {\n", "\n}", True),
    "method": ("class A<T extends B> {\n  private m = /x{2,}/g;\n  async go<T>(a: T): Promise<void> {\n", "\n  }\n}", True),
    "template code": ("const doc = `head for (;;) { ${(() => {\n", "\n})()} tail while (`;", True),
    "after a pattern": ("const re = /[/]for (;;) {`/.test(a) ? a / b : /'/;\n", "", True),
    "after strings": ("const s = \"a\\\"b {\" + 'it\\'s (';\n", "\nconst z = \"'\";", True),
    "markup code": ("const view = <Box title='for (;;) {'>it's `fine\n{(() => {\n", "\n})()}<Br/> while (</Box>;", True),
    "block comment": ("/* it's `\n", "\n*/", False),
    "template text": ("const doc = `\n", "\n`;", False),
    "markup text": ("const view = <Pre>it's\n", "\n</Pre>;", False),
}

BLOCKING: list[Labelled] = [
    ("const a = fs.readFileSync('x');", [(1, "blocking_file")]),
    ("crypto.pbkdf2Sync(\n  p, s, 1, 2\n);\nexecSync('ls');", [(1, "blocking_crypto"), (4, "blocking_child")]),
    ("for (const f of files) {\n  zlib.gzipSync(f);\n}", [(2, "blocking_zlib")]),
    ("const t = \"fs.readFileSync('x')\"; // statSync(p)\nfs.promises.readFile('x');", []),
    ("names.map(n =>\n  existsSync(n) && fs\n    .statSync(n).size);", [(2, "blocking_file"), (2, "blocking_file")]),
    ("const readFileSync = 1;\nfs.readFileSync;", []),
    ("require('fs')\n  .readdirSync(dir)\n  .forEach(f => { unlinkSync(f); });", [(1, "blocking_file"), (3, "blocking_file")]),
    ("if (/readFileSync\\(/.test(src)) { gunzipSync(b); }", [(1, "blocking_zlib")]),
]

LOOPS: list[Labelled] = [
    ("for (const a of x) {\n  for (const b of y) {\n    for (let i = 0; i < 3; i++) { f(a, b, i); }\n  }\n}", [(3, "nested-loops")]),
    ("while (i < n) {\n  new RegExp(p).test(s);\n  JSON.parse(j);\n  i++;\n}", [(2, "regex-in-loop"), (3, "json-parse-in-loop")]),
    ("for (const u of us)\n  await load(u);\nawait done();", [(2, "sequential-await-in-loop")]),
    ("rows.forEach(r => {\n  if (/a+b/.test(r)) { out.push(r); }\n});", [(2, "regex-in-loop")]),
    ("const t = `for (const a of b) { for (const c of d) { JSON.parse(${x}) } }`;\nconst r = JSON.parse(j);", []),
    ("x.filter(a => a.ok)\n  .map(a => a.v);", [(1, "chained-array-methods")]),
    ("for (const a of x) {\n  for (const b of y) {\n    b.items.map(c => c.id).some(d => d > a);\n  }\n}", [(3, "nested-array-methods"), (3, "nested-array-methods")]),
    ("do {\n  const m = s.match(/x/g);\n} while (JSON.parse(t).ok);\nwhile (q) { q = q / 2; }", [(2, "regex-in-loop"), (3, "json-parse-in-loop")]),
    ("for await (const p of pages) {\n  await p.save().catch(() => null);\n  await p.ready;\n}", [(2, "sequential-await-in-loop")]),
]

DOM: list[Labelled] = [
    ("for (const e of es) {\n  e.style.width = e.offsetWidth;\n}", [(2, "forced_sync_layout"), (2, "style_mutation_in_loop")]),
    ("const w = e.offsetWidth;\nbox.innerHTML = h;", []),
    ("es.forEach(e => {\n  box.innerHTML += e;\n});", [(2, "innerhtml_in_loop")]),
    ("while (i--) {\n  document\n    .querySelector(s);\n}", [(2, "dom_query_in_loop")]),
    ("for (const e of es) {\n  e.onclick = function () { box.innerHTML = ''; };\n}", []),
    ("for (const e of es) {\n  const t = `${e.clientTop} innerHTML = 1`;\n  e.scrollTop = 0;\n}", [(2, "forced_sync_layout")]),
    ("for (const e of es) {\n  e.style['color'] = 'red';\n  if (e.innerHTML == x) { y(); }\n}", [(2, "style_mutation_in_loop")]),
    ("do { n = n.closest('a'); } while (n.matches('b'));", [(1, "dom_query_in_loop"), (1, "dom_query_in_loop")]),
]

PAYLOADS: list[Labelled] = [
    ("db.user.findMany();", [(1, "unbounded_find_all")]),
    ("db.user.findMany({ take: 5 });\ndb.user.findFirst({ where: { a: 1 } });", []),
    ("db.a.findMany({\n  take: 1,\n  include: { b: { c: true } },\n});", [(1, "deep_nested_include")]),
    ("q(\"SELECT * FROM users\");", [(1, "select_star")]),
    ("q(`\n  select *\n  from t where id = ${id}`);", [(1, "select_star")]),
    ("const re = /SELECT \\* FROM x/;\n// SELECT * FROM y\nlist.find(x => x.id);", [(3, "unbounded_find_all")]),
    ("db.c.find({ include: { limit: 1 } });\ndb.c.findAll({ limit: 5, ...more });", [(1, "unbounded_find_all")]),
    ("db.c.findMany({ where });\ndb.c.create({ data: { a: [{ b: { c: 1 } }] } });", []),
]

LEAKS: list[Labelled] = [
    ("function a() {\n  const c = pool.getConnection();\n  c.query(q);\n}\nfunction b(c) { c.release(); }", [(2, "unclosed_connection")]),
    ("function a() {\n  const c = pool.getConnection();\n  c.release();\n}", []),
    ("const start = () => {\n  const t = setInterval(f, 1);\n  return () => clearInterval(t);\n};", []),
    ("class R {\n  open() {\n    const s = fs.createReadStream(p);\n    s.on('data', f);\n  }\n}", [(3, "unclosed_stream"), (4, "unclosed_event_listener")]),
    ("async function w() {\n  const ws = new WebSocket(u);\n  ws.send('close()');\n}", [(2, "resource_without_cleanup")]),
    ("async function h() {\n  const f = await fs.promises.open(p);\n  log(`close( ${f}`);\n}", [(2, "unclosed_connection")]),
    ("function s(res) {\n  const r = fs.createReadStream(p);\n  r.pipe(res);\n}", []),
    ("function u() {\n  const d = fs.openSync(p);\n  el.addEventListener('x', f);\n  el.removeEventListener('x', f);\n}", [(2, "unclosed_file_handle"), (2, "unclosed_stream")]),
]

UI: list[Labelled] = [
    ("useEffect(() => {\n  window.addEventListener('x', f);\n}, []);", [(1, "missing_effect_cleanup"), (2, "missing_event_listener_removal")]),
    ("useEffect(() => {\n  window.addEventListener('x', f);\n  return () => window.removeEventListener('x', f);\n}, []);", []),
    ("onMounted(() => {\n  setInterval(f, 5);\n});", [(1, "missing_lifecycle_cleanup"), (2, "missing_timer_cleanup")]),
    ("this.api.get()\n  .subscribe(x => x);", [(2, "missing_subscription_cleanup")]),
    ("bus.on('x', f);\nrequestAnimationFrame(f);", [(1, "global_event_bus_leak"), (2, "missing_raf_cancel")]),
    ("const t = \"setInterval(f)\";\nconst u = /\\.subscribe\\(/;", []),
    ("const o = new ResizeObserver(f);\no.observe(el);", [(1, "missing_observer_disconnect")]),
    ("const s = `${setTimeout(f, 1)}`;\n// clearTimeout(s)", [(1, "missing_timer_cleanup")]),
]

#: Imports stand at the top of a source, so they are put in these surroundings only.
TOP = ("alone", "after a pattern", "after strings", "block comment", "template text", "markup text")
IMPORTS: list[Labelled] = [
    ("import moment from 'moment';", [(1, "moment_import")]), ("import _ from 'lodash';\nimport { Button } from '@mui/material';", [(1, "full_lodash_import"), (2, "barrel_import")]),
    ("import get from 'lodash/get'; // import _ from 'lodash'", []), ("const _ = require('lodash');", [(1, "cjs_require")]), ("import * as _ from 'lodash';", [(1, "namespace_import")]),
    ("import {\n  A,\n  B,\n} from \"antd\";\nimport type { C } from 'antd';", [(1, "barrel_import"), (5, "barrel_import")]), ("import Button from '@mui/material/Button';\nimport 'moment';", [(2, "moment_import")]),
    ("const m = await import('moment');\nconst t = \"require('lodash')\";", []), ("if (x) { y = require(\n  'moment-timezone'\n); }", [(1, "cjs_require")]), ("import * as antd from 'antd'\nimport _, { map } from 'underscore'", [(1, "namespace_import"), (2, "full_lodash_import")]),
    ("a.import\n'moment';\nrequire.resolve('lodash');", []), ("import React from 'react';\nconst re = /import _ from 'lodash'/;", []),
]
PYTHON: list[Labelled] = [
    ("import re\nfor a in x:\n    for b in y:\n        re.match(a, b)\n", [(3, "nested-loops"), (4, "regex-in-loop")]), ("import json\nwhile x:\n    d = json.loads(s)\n    l = [i for i in d]\n", [(3, "json-parse-in-loop"), (4, "nested-comprehension")]),
    ("import re\np = re.compile('a')\nfor a in x:\n    p.match(a)\n", []), ("async def f():\n    for a in x:\n        await g(a)\n", [(3, "sequential-await-in-loop")]), ("for in broken(:\n", []),
    ('text = """\nfor a in b:\n    for c in d:\n        re.match(a)\n"""\n', []), ("for a in x:  # for b in y\n    pass\nelse:\n    re.sub('a', 'b', c)\n", [(4, "regex-in-loop")]),
    ("for a in x:\n    def f():\n        return {k: v for k, v in a}\n", [(3, "nested-comprehension")]), ("while a:\n    while b:\n        while c:\n            json.load(f)\n", [(2, "nested-loops"), (3, "nested-loops"), (4, "json-parse-in-loop")]),
    ("async def g():\n    async for a in b:\n        async for c in d:\n            x = [await h(c)]\n", [(3, "nested-loops"), (4, "sequential-await-in-loop")]), ("[x for y in z for x in y]\n", []), ("x = f'{re.match(a, b)}'\nfor c in d:\n    e = f'{re.match(c, b)}'\n", [(3, "regex-in-loop")]),
]

#: Source, then kind, signature and number of calls.
CACHE: list[tuple[str, list[tuple[str, str, int]]]] = [
    ("a = fetch( url );\nb = fetch(url);\nc = fetch(other);", [("http", "fetch | <dynamic:url> | method=GET", 2)]),
    ("fetch(`/u/${id}/x`, { method: 'head' });\nfetch(`/u/${ k({ a: 1 }) }/x`, { method: 'HEAD' });", [("http", "fetch | /u/${}/x | method=HEAD", 2)]),
    ("axios.get('/a', { params: { x: [1, { y: 2 }] } });\naxios.get('/a');\naxios.post('/a');", [("http", "axios | get | /a", 2)]),
    ("db.users.findMany({ where: { a: { in: [f(1), { b: 2 }] } } });\ndb.users\n  .findMany({ take: 1 });", [("db", "db | db.users | findMany | {...}", 2)]),
    ("formatDate(d, 'iso');\nformatDate(d,\n  'iso');\nformatDate(f(d), 'iso');", [("pure", "pure_compute | formatDate | d, iso", 2)]),
    ("client.query({ query: gql`{ a }` });\nclient.query({ query: gql`{ a }` });", [("graphql", "graphql | client | query | { a }", 2), ("graphql", "graphql | { a }", 2)]),
    ("// fetch(url); fetch(url)\nconst t = 'fetch(url) fetch(url)'; fetch(url);", []),
    ("parseRow(r.a.b, [1], {});\nparseRow(r.a.b, [2], { x });", [("pure", "pure_compute | parseRow | r.a.b, [...], {...}", 2)]),
]

#: Pattern, the rule it meets (empty: none) and how its matching grows.
PATTERNS: list[tuple[str, str, str]] = [
    ("^abc$", "", "linear"), ("^(a+)+$", "nested_quantifiers", "exponential"), ("(a*)*", "nested_quantifiers", "exponential"), ("(?:x+y)+z", "nested_quantifiers", "linear"), ("(a|b+)*c", "nested_quantifiers", "exponential"),
    ("(?<year>\\d+)+", "nested_quantifiers", "exponential"), ("([a-z]+,)*", "nested_quantifiers", "linear"), ("(\\w+\\s?)*$", "nested_quantifiers", "exponential"), ("(a{2,})+", "nested_quantifiers", "exponential"), ("(?:(?:ab)*c)*", "nested_quantifiers", "linear"),
    ("^(?:a|a)*$", "overlapping_alternatives", "exponential"), ("(?:ab|ac)+", "overlapping_alternatives", "linear"), ("(x|x)", "overlapping_alternatives", "linear"), ("(?:\\d|\\w)+!", "overlapping_alternatives", "exponential"), ("(a|b)*", "", "linear"), ("(ab|cd)", "", "linear"),
    ("[\\w.]+@[\\w.]+", "", "linear"), ("^[^@]+@[^@]+$", "email_pattern", "linear"), ("x\\.[^@]+", "email_pattern", "linear"), ("x@y+", "", "linear"), ("\\S+@\\S+", "polynomial_ambiguity", "polynomial"),
    ("https?:\\/\\/x", "url_pattern", "linear"), ("https?://", "url_pattern", "linear"), ("^[^/]+/b", "url_pattern", "linear"), ("[^:]+:\\d+", "url_pattern", "linear"), ("http", "", "linear"),
    ("a{100}", "large_repetition", "linear"), ("a{0,5000}", "high_complexity", "linear"), ("a{99}", "high_complexity", "linear"), ("x{2,3}", "", "linear"), ("a{100,}", "large_repetition", "linear"),
    ("((((a))))", "complex_groups", "linear"), ("(((a)))", "", "linear"), ("(a)(b)(c)(d)(e)(f)", "", "linear"), ("(?=(((?:a))))", "complex_groups", "linear"),
    ("^\\s*x\\s*$", "", "linear"), ("a*b*c*", "unbounded_quantifiers", "linear"), ("a+b+", "", "linear"), (".*x.*y.*", "unbounded_quantifiers", "polynomial"), ("\\p{L}+", "", "linear"), ("\\p{L}+\\p{Lu}+", "polynomial_ambiguity", "polynomial"),
    ("\\p{L}+\\p{N}+", "", "linear"), ("\\p{Script=Greek}+", "", "linear"), ("a*a*", "polynomial_ambiguity", "polynomial"), ("a*?a+", "polynomial_ambiguity", "polynomial"), ("\\d+\\d+$", "polynomial_ambiguity", "polynomial"), ("x*y*", "", "linear"),
    ("(?<a>x)\\k<a>", "", "linear"), ("(a)\\1", "", "linear"), ("[^]", "", "linear"), ("[]", "", "linear"), ("\\u{1F600}+\\x41", "", "linear"), ("[a\\-z]+[^\\]]", "", "linear"), ("(?<!a)b(?!c)", "", "linear"), ("a|b|c", "", "linear"),
    ("(", "unreadable_pattern", "unreadable"), ("a)", "unreadable_pattern", "unreadable"), ("*a", "unreadable_pattern", "unreadable"), ("[a", "unreadable_pattern", "unreadable"), ("a{3,2}", "unreadable_pattern", "unreadable"), ("[z-a]", "unreadable_pattern", "unreadable"), ("\\", "unreadable_pattern", "unreadable"),
    ("(?:[a-z]|[0-9])+", "", "linear"), ("(?:a|ab)(?:c|bcd)", "", "linear"), ("(?:a?b?)*c", "exponential_ambiguity", "exponential"), ("{", "", "linear"), ("a{,3}", "", "linear"),
]


def placed(snippets: list[Labelled], strings: bool = False, only: tuple[str, ...] = tuple(AROUND)) -> list[Labelled]:
    """Every snippet in every surrounding. A snippet with a back quote cannot stand in a template's text, one with braces not in markup text; with `strings` templates' text is searched, so none is put there."""
    out = []
    for name, (before, after, code) in ((k, AROUND[k]) for k in only):
        for source, labels in snippets:
            if name == "template text" and ("`" in source or strings) or name == "markup text" and any(c in source for c in "{<") or name == "block comment" and "*/" in source:
                continue
            down = before.count("\n")
            out.append((before + source + after, [(line + down, rule) for line, rule in labels] if code else []))
    return out


def values_sql(rows: list[tuple]) -> str:
    """Rows as the list of a VALUES clause."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def expected_sql(sources: list[Labelled]) -> str:
    """The expected (p_partkey, line, rule) rows, where a part's source is that of its key modulo their number."""
    rows = [(i, line, rule) for i, (_, labels) in enumerate(sources) for line, rule in labels]
    return f"SELECT p_partkey, e.line, e.rule FROM part JOIN (VALUES {values_sql(rows)}) AS e(i, line, rule) ON p_partkey % {len(sources)} = e.i"
