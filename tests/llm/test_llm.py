"""Each operator against brute force, exact round trips or held-out accuracy, and the edge cases that docstrings define."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from tessera.llm import ann, bpe, decontaminate, html_extract, line_dedup, lm, ngram_join, quality, setjoin, substring, textops, toxicity
from tessera.llm.store import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def documents(spark):
    """Real rows and hard ones: nulls, empties, blanks, a repeated row, a very long word, clashing extra columns."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    text = base.where("length(text) > 800").orderBy("doc_id").first()["text"]
    rows = [(-1, None), (None, text), (-2, ""), (-3, " \n\t "), (-4, "one two"), (-4, "one two"), (-5, "x" * 70_000), (-6, "same " * 80), (-7, "Ünï " + text), (-8, "one  TWO")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    return base.union(more).withColumns({"score": F.lit(1), "n_words": F.lit("x"), "spans": F.lit(None).cast("string"), "_shard": F.lit(7)}).persist()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_words_and_hashes():
    texts = ["Hello wörld  a\tb\n", None, "", "x", "  lead trail  ", "\x0bq\x1cz é", "The The"]
    w = textops.Words(pa.array(texts), textops.SPACE_WORDS)
    for i, t in enumerate(texts):
        at = range(w.rows[i], w.rows[i + 1])
        assert [w.bytes[w.start[k] : w.end[k]].tobytes().decode() for k in at] == SPACE.findall(t or "")
    h = np.arange(50, dtype=np.uint64)
    assert textops.kgram_hashes(h, 35)[3] == textops.kgram_hashes(h[3:38], 35)[0]


def test_bpe_is_exact(spark, documents):
    import public_tokenizers as P
    import tiktoken

    vocabulary = bpe.read_ranks(bpe.default_vocabulary_path())
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={v: i for i, v in enumerate(vocabulary)}, special_tokens={})
    odd = spark.createDataFrame([(1, "\x1c \x1d a\x85b  　x \n\n y"), (2, "日本語 😀 don't I'LL 12٣½"), (3, "".join(map(chr, range(0x2FF)))), (4, "▁ ▁▁")], "doc_id long, text string")
    df = documents.where("length(text) < 60000 or text is null").select("doc_id", "text").union(odd)
    expected = []
    for i, t in rows_of(df):
        ids = np.array(ref.encode_ordinary(t or ""), "<u4").tobytes()
        expected.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same([tuple(r) for r in bpe.digests(df).collect()], expected)


def test_html():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav><div id="cookie-notice">We use cookies, ok.</div>
<article><h1>Head  &amp; more</h1><p><b>First one,
 here.<br><p>Second &lt;one&gt;, too.</p><aside>Side.</aside><ul><li>a<li>b</ul></article><form><p>Sign up, now.</p></form><section class="comments"><p>Nice, one.</p></section><footer>&copy; x</footer></body></html>"""
    assert html_extract.extract(page) == "Head & more\nFirst one, here.\nSecond <one>, too.\na\nb"
    assert [html_extract.extract(x) for x in (None, "", "<nav>x</nav>", "plain, text.", "<p>open")] == ["", "", "", "plain, text.", "open"]


def test_html_of_several_articles():
    long, short = "<p>Some long sentence, with a point, of the first part, and more of it.</p>" * 3, "<p>A second part, which is shorter.</p>"
    body = f'<article class="one">{long}</article><article class="two">{short}<ul><li>x</li></ul></article>'
    expected = ["Some long sentence, with a point, of the first part, and more of it."] * 3 + ["A second part, which is shorter.", "x"]
    assert html_extract.extract(f"<body><main><h1>Title</h1><nav>Menu</nav>{body}</main><footer>End, here.</footer></body>").split("\n") == ["Title", *expected]
    assert html_extract.extract(f"<body>{body}</body>").split("\n") == expected


ARTICLE = "<h1>A title</h1>" + "<p>A sentence of the article, with a point. And one more, of course.</p>" * 4
EXPECTED = "\n".join(["A title", *["A sentence of the article, with a point. And one more, of course."] * 4])
SIDE = '<div class="sidebar"><h3>More</h3><ul><li><a href="/x">Another story, here</a></ul></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm"><article>{ARTICLE}</article>{SIDE}</form>',
        f'<div class="site has-sidebar"><article>{ARTICLE}</article>{SIDE}</div>',
        f'<div class="layout no-sidebar"><main>{ARTICLE}</main></div><footer>x</footer>',
        f'<article><div class="story-header"><h1>A title</h1></div>{ARTICLE[16:]}</article>',
        f'<article>{ARTICLE}</article><section id="comments"><article><p>Nice one, I like it.</p></article></section>',
        f'<article>{ARTICLE}<section class="comments"><p>Nice one, I like it. Really, I do.</p></section></article>',
        f'<div><div>{ARTICLE}</div><div>Short, this.</div></div>',
        f'<div class="content">{ARTICLE}</div><form><p>Sign up now, please.</p><input></form>',
        f'<article>{ARTICLE}</article><button>Open<p>never closed',
        f'<article>{ARTICLE}</article><div class="x" title="unclosed>',
        f"<article class=a<b>{ARTICLE}</article>",
    ],
)
def test_html_wrappers(page):
    text = html_extract.extract(f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{page}</body></html>")
    assert text.startswith(EXPECTED) and len(text) <= len(EXPECTED) + 30


def test_html_ratios_decide(monkeypatch):
    """With all ratios alike, what is no text in sentences comes in."""
    teasers = "<article class=card><h2>Other</h2><p>Some</p></article>" * 2
    pages = [f"<body><article>{ARTICLE}</article>{teasers}</body>", f"<body><div>{ARTICLE}</div><div><div>Short, this</div></div></body>"]
    assert [html_extract.extract(p) for p in pages] == [EXPECTED] * 2
    monkeypatch.setattr(html_extract, "path_ratios", lambda paths, lines, linked, prior: (prior, [p > 0 for p in prior]))
    assert all(html_extract.extract(p) != EXPECTED for p in pages)


def test_html_takes_linear_time():
    import time

    began = time.time()
    for page in ("<div\n" + " " * 10_000 + "class=x", "<div " * 20_000, "<a '" * 20_001, "<button>" * 20_000, "<div " + "a='" * 20_001, "<!--" * 20_000, "</" * 50_000, "<script" * 10_000, "<p><b>" * 5_000):
        assert isinstance(html_extract.extract(page), str)
    assert time.time() - began < 5
    began = time.time()
    html_extract.extract("<div\n" + " " * 10_000 + "class=x")
    assert time.time() - began < 0.1


def test_html_edges(spark):
    rows = [(1, "u", None, "a"), (1, "u", None, "a"), (2, None, "<article>" + "<p>Some text, and more of it.</p>" * 60_000, "b"), (None, "v", "<p>One, two.</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], len(r["text"]), r["n_chars"]) for r in html_extract.main_text(df).collect()}
    assert got == {(1, 0, 0), (2, 60_000 * 27 - 1, 60_000 * 27 - 1), (None, 9, 9)}
    assert html_extract.extract_pages(df).columns == ["page_id", "url", "html", "text"] and html_extract.main_text(df).count() == 4
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_pages_match_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in html_extract.main_text(pages.union(spark.createDataFrame([(-1, None, None)], pages.schema))).join(pages, ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_decontamination(spark, documents):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").union(spark.createDataFrame([(900, "one two"), (901, None), (902, "..."), (None, "x" * 70_000)], "item_id long, text string"))
    windows = {}
    for r in benchmark.collect():
        w = ALNUM.findall(low(r["text"]))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(r["item_id"])
    expected = []
    for i, t in rows_of(documents):
        w, hit, items = ALNUM.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    items |= windows[k] - {None}
        expected.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    same([tuple(r) for r in decontaminate.report(documents, benchmark).collect()], expected)
    blocks = decontaminate.judged(decontaminate.find(documents.select("doc_id", "text"), benchmark, block=7))
    same([(r["doc_id"], r["n_words"], r["n_hit"]) for r in blocks.collect()], [x[:3] for x in expected])
    assert decontaminate.decontaminate(documents, benchmark).columns == documents.columns
    assert decontaminate.report(documents.limit(0), benchmark).count() == 0 and decontaminate.report(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("frequent", [2000, 2])
def test_substrings(documents, frequent):
    rows = rows_of(documents)
    words = [SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(w) - 34):
            if seen[tuple(w[a : a + 35])] > 1:
                gone.update(range(a, a + 35))
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    same([tuple(r) for r in substring.mark(documents, frequent=frequent).collect()], expected)
    assert substring.mark(documents.limit(0)).count() == 0


def test_factors_decide_spans():
    """The factors of a block of stretches give the repeated windows; without the long factors, or without the windows over their ends, some are lost."""
    rng = np.random.default_rng(3)
    lost = Counter()
    for _ in range(200):
        window = int(rng.integers(3, 8))
        base = rng.integers(0, 4, 60)
        stretches = []
        for _ in range(int(rng.integers(2, 7))):
            i, n = int(rng.integers(0, 40)), int(rng.integers(window, 20))
            stretches.append(np.concatenate([base[i : i + n], rng.integers(0, 9, int(rng.integers(0, 6)))]))
        first = np.concatenate([[0], np.cumsum([len(x) for x in stretches])])
        block = substring.ReferenceBlock(np.concatenate(stretches), first, window)
        seen = Counter(tuple(x[i : i + window]) for x in stretches for i in range(len(x) - window + 1))
        expected = np.concatenate([[i + window <= len(x) and seen[tuple(x[i : i + window])] > 1 for i in range(len(x))] for x in stretches])
        assert np.array_equal(block.repeated(), expected)
        start, length = block.parse()
        assert length.sum() == first[-1]
        lost["ends"] += int(expected.sum() - block._spread(start, length - window + 1).sum())
        block.parse = lambda s=start, n=length: (s, np.zeros_like(n))  # without factors
        lost["factors"] += int(expected.sum() - block.repeated().sum())
    assert lost["ends"] > 0 and lost["factors"] > 0


def test_keys_spread_over_buckets():
    """Least hashes, and the first elements of sets, are dealt evenly to buckets of the hash space."""
    rng = np.random.default_rng(0)
    vocabulary = textops.mix(np.arange(20_000, dtype=np.uint64))
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 20_000) for _ in range(300)]
    keys = np.unique(substring.Windows(pa.table({"text": texts}), 35, 12).key)
    values = np.unique(setjoin.mix(np.sort(vocabulary)[:2000] + setjoin._SPREAD))
    for found in (keys, values):
        n = np.bincount((found >> np.uint64(58)).astype(int), minlength=64)
        assert n.max() < 2 * n.mean()


def test_ngram_join(documents):
    rows = rows_of(documents)
    sets = []
    for _, t in rows:
        w = SPACE.findall(low(t))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    same([tuple(r) for r in ngram_join.report(documents).collect()], [(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)])
    kept = ngram_join.first_of_each(documents, n=4, percent=85)
    assert kept.columns == documents.columns
    assert kept.count() == len({find(k) for k in range(len(rows)) if sets[k]}) + sum(not s for s in sets)


def test_line_dedup(documents):
    rows = sorted((r for r in rows_of(documents) if r[0] is not None and r[0] != -4), key=lambda r: r[0])
    df = documents.where("doc_id is not null and doc_id <> -4")
    kept, seen, expected = [], [], []
    for i, t in rows:
        own = []
        lines = (t or "").split("\n")
        for line in lines:
            s = set(SPACE.findall(low(line)))
            match = s and any(100 * (o := len(s & x)) >= 80 * (len(s) + len(x) - o) for x in seen)
            if s:
                seen.append(s)
            if not match:
                own.append(line)
        kept.append(own)
        expected.append((i, len(lines), len(lines) - len(own), None if t is None else hashlib.sha256("\n".join(own).encode()).hexdigest()))
    same([tuple(r) for r in line_dedup.report(df).collect()], expected)
    assert line_dedup.without_repeats(documents).columns == documents.columns and line_dedup.without_repeats(documents).count() == documents.count()
    assert line_dedup.report(documents.limit(0)).count() == 0


def test_line_dedup_of_equal_sets(spark):
    """Lines of one template (of similarity 39 / 49) lead the keys of later ones; their reordered and word-repeating copies go all the same."""
    lines = [" ".join([f"s{k}" for k in range(39)] + [f"d{i}x{k}" for k in range(5)]) for i in range(400)]
    late = [line.split() for line in lines[300:]]
    copies = [" ".join(w[::-1]) for w in late] + [" ".join(w + w[:5]) for w in late]
    df = spark.createDataFrame([(1, "\n".join(lines + copies)), (2, "\n".join(copies[:3]))], "doc_id long, text string")
    same([tuple(r) for r in line_dedup.removals(df).collect()], [(1, "\n".join(lines), 600, 200), (2, "", 3, 3)])


def test_language_model(documents):
    rows = rows_of(documents)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, t in rows if not held(i) for x in [*SPACE.findall(low(t)), None])
    total, distinct = sum(c.values()), len(c)
    got = sorted(lm.score(documents).collect(), key=repr)
    assert len(got) == len(rows)
    base = {}
    for i, t in rows:
        tokens = [*SPACE.findall(low(t)), None]
        base.setdefault(i, []).append((held(i), len(tokens), sum(c[x] > 0 for x in tokens), sum(np.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens)))
    for r in got:
        assert r["train_tokens"] == total and r["score"] < 0
        assert any((r["held_out"], r["n_tokens"], r["n_known"]) == b[:3] and abs(r["base_score"] - b[3]) < 1e-6 * abs(b[3]) for b in base[r["doc_id"]])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    # the score, from plain counts of one, two and three tokens
    two, three, starts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            tokens = ["^", *SPACE.findall(low(t)), None]
            starts += 1
            two.update(zip(tokens, tokens[1:], strict=False))
            three.update(zip(tokens, tokens[1:], tokens[2:], strict=False))
    whole = {}
    for i, t in rows:
        tokens, sum_ = ["^", *SPACE.findall(low(t)), None], 0.0
        for k in range(1, len(tokens)):
            p = (c[tokens[k]] + 0.1) / (total + 0.1 * (distinct + 1))
            p = (two[tokens[k - 1], tokens[k]] + lm.PRIORS[0] * p) / ((starts if k == 1 else c[tokens[k - 1]]) + lm.PRIORS[0])
            if k > 1:
                p = (three[tokens[k - 2], tokens[k - 1], tokens[k]] + lm.PRIORS[1] * p) / (two[tokens[k - 2], tokens[k - 1]] + lm.PRIORS[1])
            sum_ += np.log10(p)
        whole.setdefault(i, []).append(sum_)
    for r in got:
        assert any(abs(r["score"] - x) < 1e-9 * abs(x) for x in whole[r["doc_id"]])
    assert lm.score(documents.limit(0)).count() == 0


def test_backoff_automaton_is_normalised():
    """The probabilities of all tokens after a state add up to one, for states of each order; an unseen word stands for what is left of the base."""
    words = np.array([3, 1, 2, 0])  # total 6, three seen; word 3 is any unseen one, with twice its share of the mass left (0.1 of 6.4)
    pairs = np.array([[-1, 0], [0, 1], [1, 2], [0, 0], [0, 2], [0, 3], [1, 0], [1, 1], [1, 3], [-1, 1], [-1, 2], [-1, 3]]), np.array([2, 2, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0])
    triples = np.array([[1, 2], [1, 6], [1, 7], [1, 8], [0, 3], [0, 1], [0, 4], [0, 5]]), np.array([2, 0, 0, 0, 1, 1, 0, 0])
    automaton = lm.BackoffAutomaton(words, 6, 3, 2, (pairs[0][:, 0], pairs[0][:, 1], pairs[1]), (triples[0][:, 0], triples[0][:, 1], triples[1]), (5.0, 2.0))

    def after(history, pair_ids, triple_ids):
        """Probabilities of the four words after a text that begins with `history`."""
        out = []
        for w in range(4):
            tokens = [*history, w]
            got = automaton.traverse(np.array([0, len(tokens)]), np.array(tokens), np.array([*pair_ids[0], pair_ids[1][w]]), np.array([*triple_ids[0], triple_ids[1][w]]))
            out.append(10 ** got[-1])
        return out

    base = (words + 0.1) / (6 + 0.1 * 4)
    assert np.isclose(base.sum(), 1)
    for p in (after([0], ([0], [3, 1, 4, 5]), ([-1], [4, 5, 6, 7])), after([0, 1], ([0, 1], [6, 7, 2, 8]), ([-1, 5], [1, 2, 0, 3])), after([], ([], [0, 9, 10, 11]), ([], [-1] * 4))):
        assert np.isclose(sum(p), 1)


def test_traversal_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["a", "b", "c", "d", "of the"], 300))
    got = []
    for piece in (3, 10_000):
        monkeypatch.setattr(lm, "PIECE", piece)
        table = pa.table({"id": [1, 2], "text": [text, text[:40]]})
        t = lm.Tokens(table, 10, 11)
        _, word = np.unique(t.token, return_inverse=True)
        _, at, pair = np.unique(t.pair, return_index=True, return_inverse=True)
        before = np.concatenate([[-1], word[:-1]])
        before[t.first[:-1]] = -1
        later = np.flatnonzero(t.later)
        _, third_at, third = np.unique(t.triples(), return_index=True, return_inverse=True)
        triple = np.full(len(word), -1)
        triple[later] = third
        even = lambda n: np.arange(n) % 3  # some arcs are missing
        automaton = lm.BackoffAutomaton(np.bincount(word), len(word), 6, 2, (before[at], word[at], even(len(at))), (pair[later[third_at] - 1], pair[later[third_at]], np.minimum(even(len(third_at)), even(len(at))[pair[later[third_at]]])), lm.PRIORS)
        got.append(automaton.traverse(t.first, word, pair, triple))
    assert np.array_equal(*got)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    v = (centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3000 + i, v[7].tolist()) for i in range(30)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None]), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard=1500).toPandas()
    ids, x = np.arange(3030), np.concatenate([v, np.repeat(v[7:8], 30, 0)]).astype(float)
    n = np.sqrt((x * x).sum(1))
    found = 0
    for q in range(0, 3030, 50):
        s = x @ x[q] / (n * n[q])
        s[q] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5 and np.allclose(mine.score, s[mine.vec_id]) and mine.score.is_monotonic_decreasing
        found += len({*best} & {*mine.vec_id})
    assert found / (5 * len(range(0, 3030, 50))) >= 0.9 and set(got.query_id) == set(range(0, 3030, 50))
    few = ann.nearest(df.where("vec_id in (0, 7)"), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    clash = df.withColumns({"_id": F.lit(1), "_v": F.lit("x"), "_s": F.lit(2), "_q": F.lit(False), "score": F.lit(0)})
    assert sorted(map(tuple, ann.nearest(clash, F.col("vec_id") % 50 == 0, shard=1500).collect())) == sorted(map(tuple, got.itertuples(index=False)))
    assert ann.search(df.limit(0)).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0


def test_small_graphs_reach_all():
    """Without a comparison of all vectors, small shards still find every candidate: no node is out of reach."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 6, 30, 79):
        x = rng.normal(size=(n, 8))
        x /= np.sqrt((x * x).sum(1))[:, None]
        near, sims = ann.Graph(x).search(x.astype(np.float32)[:5], 80)
        for row, s in zip(near, sims, strict=True):
            assert sorted(row[np.isfinite(s)]) == list(range(n))


def test_recall_of_a_whole_shard():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(ann.SHARD, 32))
    x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    near, _ = ann.Graph(x).search(x[:200], ann.BEAM)
    best = np.argsort(-(x[:200] @ x.T), 1)[:, :6]
    assert sum(len({*a[:40]} & {*b}) for a, b in zip(near, best, strict=True)) >= 0.9 * best.size


def _labelled(spark):
    path = DATA.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_quality_held_out(spark):
    docs, labels = _labelled(spark)
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, "a\n\nb")], "doc_id long, text string"))
    rows = quality.classified(extra, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    small = extra.where("doc_id is null or doc_id < 300").withColumns({"score": F.lit("x"), "weight": F.lit(1)})
    none = quality.classified(small, labels.limit(0)).collect()
    assert len(none) == small.count() and {r["score"] for r in none} == {0.5}
    assert quality.classified(small.limit(0), labels).count() == 0
    field = quality.train(docs.where("doc_id < 2000"), labels)
    again = {}
    for r in quality.score(small.union(small), field).collect():
        again.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in again.values()) and again[None] == again[""]


def test_forward_backward_is_exact():
    from itertools import product

    rng = np.random.default_rng(0)
    score, trans, rows = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 4, 5])
    p, _ = quality.marginals(score, trans, rows)
    w = {y: np.exp(sum(s * b for s, b in zip(score[:4], y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=4)}
    for t in range(4):
        assert abs(p[t] - sum(v for y, v in w.items() if y[t]) / sum(w.values())) < 1e-9
    assert abs(p[4] - 1 / (1 + np.exp(-score[4]))) < 1e-9


def test_toxicity_held_out(spark):
    docs, labels = _labelled(spark)
    rows = toxicity.classified(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.toxic).mean() > 0.95 and (rows[rows.toxic == 0].predicted == 0).mean() > 0.98


def test_counterfactual_penalty():
    """A term that toxic rows mention more often moves scores less with the penalty."""
    rng = np.random.default_rng(1)
    fill = [f"w{i}" for i in range(50)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = list(rng.choice(fill, 12)) + (["idiot"] if toxic and rng.random() < 0.6 else []) + (["muslims"] if rng.random() < (0.7 if toxic else 0.1) else [])
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    row, slot = toxicity.features(pa.array(texts))
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    rows = [slot[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    pairs = toxicity.pair_slots(toxicity.counterfactuals(texts))
    probe = pa.array(["w1 muslims w2.", "w1 christians w2.", "w1 idiot w2."])
    plain, fair = (toxicity.fit(rows, np.array(labels), pairs, **p).score(probe) for p in ({"penalty": 0.0}, {}))
    assert abs(fair[0] - fair[1]) < 0.5 * abs(plain[0] - plain[1]) and fair[2] > 0.7


def test_toxicity_of_texts_that_name_groups(spark):
    """Through the query's own path, at the default penalty: neutral mentions of a group that toxic rows often name are not flagged."""
    rng = np.random.default_rng(4)
    fill, rows, marks = [f"w{i}" for i in range(60)], [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = list(rng.choice(fill, 12)) + (["idiot", "scum"] if toxic and rng.random() < 0.8 else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.05) else [])
        rows.append((i, " ".join(words) + "."))
        marks.append((i, int(toxic), 1))
    docs = spark.createDataFrame([*rows, *[(1000 + i, " ".join(rng.choice(fill, 12)) + " muslims.") for i in range(60)], (2000, None), (2001, ""), (2002, rows[0][1]), (None, rows[0][1])], "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(9), "_label": F.lit(1)})
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    neutral = {}
    for name, groups in (("plain", ()), ("fair", toxicity.IDENTITY_TERMS)):
        model = toxicity.train(docs, labels, groups=groups)
        assert (model.pairs > 0) == bool(groups)
        got = toxicity.score(docs, model).select("doc_id", "score").toPandas()
        assert len(got) == docs.count() and got.score.notna().all() and len({*got[(got.doc_id == 2002) | got.doc_id.isna() | (got.doc_id == 0)].score}) == 1
        neutral[name] = got[got.doc_id.between(1000, 1100)].score.mean()
    assert neutral["fair"] < 0.75 * neutral["plain"] and neutral["fair"] < 0.5
    out = toxicity.classified(docs, labels).toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and not out[out.doc_id.isna()].held_out.any()
    assert toxicity.classified(docs.limit(0), labels).count() == 0
    assert {round(r["score"], 4) for r in toxicity.classified(docs, labels.limit(0)).collect()} == {0.001}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(20)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (40, 2))]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    field = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, field).where("score >= 0.7").collect()}
    first = corpus_pipeline.quality_classifier(spark, docs, DATA)
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == docs.columns
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and {r["doc_id"] for r in out} <= good and all(r["n_tokens"] * 4 == len(r["ids_le"]) for r in out)


def test_pipeline_stages(spark, documents):
    """Stages against brute force on hard rows: near duplicates at five words and 80 %, clean documents by the contamination rule, ids as tiktoken's."""
    import public_tokenizers as P
    import tiktoken

    docs = documents.withColumn("n_chars", F.length("text"))
    rows = rows_of(docs)
    sets = []
    for _, t in rows:
        w = SPACE.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                parent[find(a)] = find(b)
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = Counter(rows_of(kept))
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k) if sets[k] else -1 - k, []).append(row)
    expected = [min((r for r in g if r[0] is not None), default=g[0], key=lambda r: r[0]) for g in groups.values()]
    assert sorted(map(repr, (r[0] for r in got.elements()))) == sorted(map(repr, (r[0] for r in expected)))
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    assert all(t in texts[i] for i, t in got)
    report = {r["doc_id"]: r["contaminated"] for r in decontaminate.report(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, DATA)
    assert clean.columns == docs.columns
    same(rows_of(clean), [r for r in rows if not report[r[0]]])
    vocabulary = bpe.read_ranks(bpe.default_vocabulary_path())
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={v: i for i, v in enumerate(vocabulary)}, special_tokens={})
    some = docs.where("text is null or length(text) < 60000")
    for r in corpus_pipeline.byte_level_bpe(spark, some, DATA).collect():
        ids = [np.array(ref.encode_ordinary(t or ""), "<u4").tobytes() for t in texts[r["doc_id"]] if len(t or "") < 60_000]
        assert r["ids_le"] in ids and r["n_tokens"] * 4 == len(r["ids_le"])
    lines = corpus_pipeline.line_deduplication(spark, docs, DATA)
    assert lines.columns == docs.columns and lines.count() == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_bpe_edges(spark):
    """An empty table, very long words, and columns named as the results."""
    df = spark.createDataFrame([(1, "x" * 300_000, "a"), (2, "ab" * 100_000, "b")], "doc_id long, text string, ids_le string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df).collect()}
    assert bytes(got[1]["decoded"]) == b"x" * 300_000 and bytes(got[2]["decoded"]) == b"ab" * 100_000
    assert bpe.digests(df.limit(0)).count() == 0


def test_long_texts_are_taken_alone():
    """Slices hold a bounded number of bytes, or one row."""
    batch = pa.record_batch([pa.array(["a" * 100] * 50 + ["b" * 10**6] + ["c"] * 5), pa.array(range(56))], ["text", "n"])
    got = [x for x in textops.sliced([batch], 512, 1000, 0)]
    assert sum(x.num_rows for x in got) == 56 and max(x.num_rows for x in got) <= 10 and [x.num_rows for x in got if x.column(0)[0].as_py()[0] == "b"] == [1]
