"""Infilling, spelling variants and URL rules against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urldefrag, urljoin

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from stipendia.llm import infill, spelling, url_filter
from stipendia.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- fill in the middle ----------------------------------------------------------------------------

def infilled(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def _digests(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for i, t in rows:
        n, form, output, p, m = infilled(i, t)
        out.append((i, n, form, p, m, sha(output), sha(t or "")))
    return sorted(out, key=repr)


def test_infill_of_documents(spark, sf_dir, rows_of_docs):
    df = QUERIES["op11_infill"](spark, sf_dir)
    assert sorted(map(tuple, df.collect()), key=repr) == _digests(rows_of_docs)
    assert difference(df, connect(sf_dir), SQL["op11_infill"]) is None


def test_infill_odd(spark, odd, empty):
    assert sorted(map(tuple, infill.digest(infill.infilled(odd)).collect()), key=repr) == _digests(
        [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert infill.infilled(empty).count() == 0


def test_infill_marks_and_shapes(spark):
    pieces = ["<P", ">", "<S", "<M", "S>", "<", " ", "\n", "\t \r", "a", "é😀", "$1", "\\", "word", "}", "{2}", "\x0b", "\x85", " ", "<P>", "<M>"]
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(pieces[:-2] if i % 9 else pieces) for _ in range(rng.randrange(1, 40)))) for i in range(700)]
    rows += [(1000 + i, "x y " * 150_000 + "z" * i) for i in range(6)] + [(2000 + i, "w" * 400_000) for i in range(6)]
    rows += [(3000 + i, " " * 300_000) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, infill.digest(infill.infilled(docs)).collect()), key=repr)
    assert got == _digests(rows) and {g[2] for g in got} == {"plain", "psm", "spm"}


# --- spelling variants -----------------------------------------------------------------------------

def _counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _grouped(counts):
    holes = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
    near = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            near[w] |= holes[w[:k], w[k + 1:]] - {w}
        for k in range(len(w) + 1):
            for v in holes.get((w[:k], w[k:]), ()):
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=repr)


def test_spelling_of_documents(spark, sf_dir, rows_of_docs):
    got = sorted(map(tuple, QUERIES["op12_spelling"](spark, sf_dir).collect()), key=repr)
    want = _grouped(_counts(rows_of_docs))
    assert got == want and sum(w[1] is not None for w in want) > 10


@pytest.mark.parametrize("parts", ["1", "7"])
def test_spelling_words(spark, parts):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 4) ** 8 for _ in range(900)}
    words |= {"a" * k: 3 ** k for k in range(1, 14)} | {"z" * 3000: 7, "z" * 2999 + "y": 90, "z" * 3001: 1, "zz" + "y" * 2000: 2}
    words |= {"q" + chr(c) + "q": c for c in range(0xC0, 0x100)}
    df = spark.createDataFrame([(None, 4, "x"), ("", 9, "x")] + [(w, n - 1, "x") for w, n in words.items()]
                               + [(w, 1, "y") for w in words], "word string, n long, id string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, spelling.spelling_groups(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == _grouped(words)


def test_trie_nodes(spark):
    words = ["a", "ab", "abc", "abd", "b", "ba", "éa", "éab", "x" * 50]
    nodes = {r.key: r.nodes for r in spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "key string").repartition(4)).collect()}
    named = {}
    for w in words:
        assert len(nodes[w]) == len(w) + 1
        for d, x in enumerate(nodes[w]):
            assert named.setdefault(x, w[:d]) == w[:d]
    assert len(named) == len({w[:d] for w in words for d in range(len(w) + 1)})


def test_spelling_odd(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(tuple, spelling.spelling_groups(spelling.counted(odd)).collect()), key=repr)
    assert got == _grouped(_counts(rows))
    assert spelling.spelling_groups(spelling.counted(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(spelling.counted(empty), 1)


# --- URL rules -------------------------------------------------------------------------------------

def _page(i, url, head="", body=""):
    return i, url, None if head is None else f"<html><head>{head}</head><body>{body}</body></html>"


def _canonical(href):
    return f'<link rel="canonical" href="{href}">'


PAGES = [
    _page(1, "http://shop.example.net/fr/1"), _page(2, "https://mirror.org/de/1", _canonical("HTTP://Shop.Example.NET/fr/1#top")),
    _page(3, "https://far.org/x", "<meta content='0; URL=https://mirror.org/de/1' http-equiv='Refresh'>"),
    _page(4, "https://far.org/fr/y", _canonical("https://far.org/x")),  # an allow rule of its own
    _page(5, "https://far.org/y/z?q=1#f", _canonical("../x")), _page(6, "https://clean.org/a", _canonical("/b")),
    _page(7, "https://clean.org/b"), _page(8, "https://clean.org/c", "<!-- " + _canonical("http://bad.net/") + " -->"),
    _page(9, "https://clean.org/d", f"<script>var x='{_canonical('http://bad.net/')}';</script>"),
    _page(10, "https://clean.org/e", "<link rel=stylesheet href=http://bad.net/x><link rel='alternate canonical' href=//bad.net/x?a=1&amp;b=2>"),
    _page(11, "https://clean.org/f", _canonical("?p=2")), _page(12, "https://clean.org/f?p=2", _canonical("javascript:void(0)")),
    _page(13, None, _canonical("http://bad.net/")), _page(14, "no scheme at all", _canonical("http://bad.net/")),
    _page(15, "https://www.example.net/en/1"), _page(16, "https://www.example.com/de/2"), _page(17, "https://www.example.com/en/2"),
    _page(18, "https://other.com/2", _canonical("https://www.example.net/en/1")), _page(19, "http://net", None), _page(20, "http://x.net", ""),
    _page(21, "https://clean.org/g", "<meta http-equiv=refresh content=5>"), _page(22, "https://clean.org/h/./i/../../k", _canonical("https://bad.net/k")),
    _page(23, "https://clean.org/k"), _page(24, "https://Clean.org/k#part"), _page(24, "https://Clean.org/k#part"),
    _page(25, "https://evil.net:8080/a"), _page(26, "https://clean.org/m", _canonical("")), _page(None, "ftp://a.org/fr/", None),
    _page(27, "https://clean.org/n", "<link\nrel=\"canonical\"\n href=\"z/../../o/..\"\n/>"), _page(28, "https://clean.org/", _canonical("https://q.net/" + "a" * 5000)),
    _page(29, "https://long.org/" + "s/" * 4000, "<link rel=canonical href='x' title='" + "t" * 90_000 + "'>"),
]
TAGS = re.compile(r"""<(?:link|meta)(?:[^>"']|"[^"]*"|'[^']*')*>""", re.I)


def _attributes(tag):
    found = re.findall(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", tag)
    return {k.lower(): (v[1:-1] if v[0] in "\"'" else v).replace("&amp;", "&") for k, v in found}


def _node(url):
    url = urldefrag(url)[0]
    found = re.match(r"([A-Za-z][\w+.-]*://[^/?#]+)(.*)", url, re.S)
    if not found:
        return None
    head, rest = found[1].lower(), found[2]
    return urljoin(f"{head}/", rest) if rest[:1] == "/" else head + rest


def _verdicts(pages, redirects=()):
    def rule(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    neighbours = defaultdict(set)
    edges = [(_node(a), _node(b)) for a, b in redirects]
    for _, url, html in pages:
        base = _node(url or "")
        clean = re.sub(r"(?s)<!--.*?-->|<script.*?</script>", "", html or "")
        for a in map(_attributes, TAGS.findall(clean)):
            link = a.get("href") if "canonical" in a.get("rel", "").split() else None
            if a.get("http-equiv", "").lower() == "refresh" and "=" in a["content"]:
                link = a["content"].split("=", 1)[1]
            if base and link and not link.startswith("javascript"):
                edges.append((base, _node(urljoin(base, link))))
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    out = []
    for i, url, _ in pages:
        host, path, name, verdict = rule(url)
        todo, seen = [_node(url or "")], {_node(url or "")} - {None}
        while seen and todo:
            for x in neighbours[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        spread = "block" if any(rule(x)[3] == "block" for x in seen) and len(seen) > 1 else "allow"
        out.append((i, host, path, name, verdict or spread))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.selectExpr("*", *[f"'x' AS {n}" for n in ("id", "address", "component", "blocked", "a", "b", "tag", "own", "link")])


def test_url_rules(spark, pages, tmp_path):
    df = url_filter.judged(pages).select(*COLUMNS)
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == _verdicts(PAGES)
    by = {g[0]: g[4] for g in got}
    assert [by[k] for k in (2, 3, 4, 5, 6, 8, 9, 10, 13, 18, 22, 23, 24)] == \
        ["block", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block", "block", "block"]
    parquet.write_table(pages.select("page_id", "url", "html").toArrow(), f"{tmp_path}/pages.parquet")
    assert difference(df, connect(str(tmp_path)), SQL["op13_url_filter"]) is None


def test_url_rules_with_redirects(spark, pages):
    log = [("https://clean.org/a", "https://step.org/1"), ("https://step.org/2", "https://step.org/1"), ("https://step.org/2", "http://bad.net/z"),
           ("https://clean.org/c", None), (None, "http://bad.net/z"), ("https://clean.org/d", "https://clean.org/d#x")]
    redirects = spark.createDataFrame(log, "from_url string, to_url string")
    got = sorted(map(tuple, url_filter.judged(pages, redirects=redirects).select(*COLUMNS).collect()), key=repr)
    assert got == _verdicts(PAGES, [x for x in log if None not in x]) and {g[0]: g[4] for g in got}[7] == "block"


def test_url_rules_of_one_hot_address(spark):
    rows = [_page(i, f"https://h{i}.org/p", _canonical("https://hub.org/")) for i in range(400)] + [_page(900, "https://hub.org/", _canonical("http://t.net/x"))]
    rows += [_page(1000 + i, f"https://c{i}.org/", _canonical(f"https://c{i + 1}.org/")) for i in range(60)]
    got = sorted(map(tuple, url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).select(*COLUMNS).collect()), key=repr)
    assert got == _verdicts(rows)


def test_url_rules_of_pages(spark, sf_dir, pages):
    df = QUERIES["op13_url_filter"](spark, sf_dir)
    assert difference(df, connect(sf_dir), SQL["op13_url_filter"]) is None
    assert url_filter.judged(pages.where("page_id = -1")).count() == 0
    assert url_filter.judged(pages, rules=()).where("verdict = 'block' or rule is not null").count() == 0


def test_addresses(spark):
    cases = [("http://A.b/c/../d?x=/../y#z", "http://a.b/d?x=/../y"), ("HTTP://a.b", "http://a.b"), ("http://a.b/..", "http://a.b/"),
             ("http://a.b/c/.", "http://a.b/c/"), (" http://a.b/\n", "http://a.b/"), ("//a.b/", None), ("", None), (None, None), ("http:///x", None)]
    df = spark.createDataFrame(cases, "url string, want string").select(url_filter.address(F.col("url")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
