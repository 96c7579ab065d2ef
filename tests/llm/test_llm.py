"""The training-data operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inspectlake.llm import chat, decontam, langid, naming, ngram_join, pieces, pii, sitetree, toxicity, warc
from inspectlake.llm.common import tie, written
from inspectlake.llm.naming import numbered

FOLDER = "/root/testdata/sf0.001"
LONG = "long text " * 9000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, uid long, component_id string, score string"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "c", "x") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long one, ties, repeated rows and columns named like results."""
    return documents(spark, [None, "", "  ", LONG, LONG, "a b c", "a b c", "A b c", None], [0, 1, 2, 3, 4, 5, 5, None, None])


def test_exact_groups(spark, odd):
    rows = naming.exact_groups(numbered(odd), block_bytes=64).collect()
    assert len(rows) == 9 and sum(r.kept for r in rows) == 5
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[0].keep_id, by[1].keep_id, by[3].keep_id, by[3].group_size) == (1, 1, 4, 2)
    assert by[3].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert naming.exact_dedup(odd).columns == odd.columns
    assert sorted(r.doc_id for r in naming.exact_dedup(odd).collect() if r.doc_id is not None) == [1, 2, 4, 5]
    assert naming.exact_groups(numbered(odd.limit(0))).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(texts)), 2):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return [(k, len(sets[k]), root[k]) for k in range(len(texts))]


def test_near_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    draw = random.Random(4)
    base = [" ".join(draw.choice("abcdefghij") * 3 + str(draw.randrange(50)) for _ in range(60)) for _ in range(6)]
    texts = [None, "", "one two", "one two", "five words are just enough"]
    for text in base:
        words = text.split()
        for _ in range(9):
            words = list(words)
            words[draw.randrange(60)] = f"new{draw.randrange(1000)}"
            texts.append(" ".join(words))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(numbered(documents(spark, texts))).collect())
    assert got == brute_components(texts)


@pytest.mark.parametrize("block", [2048, 100])
def test_a_large_group_of_near_copies_is_not_paired_with_itself(spark, monkeypatch, block):
    """Each copy changes other words, so most are linked with few but the original, which has the largest id."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    tried, plain = [], ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, *more: (tried.append(pairs.count()), plain(pairs, *more))[1])
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{i}" if k % 50 == i % 45 else w for k, w in enumerate(base)) for i in range(420)] + [" ".join(base)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(numbered(documents(spark, texts))).collect()}
    assert got == dict.fromkeys(range(len(texts)), 0)
    assert sum(tried) < 8 * len(texts)


def test_sums_of_minima_of_all_pairs():
    draw = np.random.default_rng(6)
    x, y = ([draw.poisson(1.5, groups) for groups in sizes] for sizes in ((64, 256, 128), (256, 64)))
    want = [[ngram_join.most_shared(ngram_join._fold(a, 64), ngram_join._fold(b, 64)) for b in y] for a in x]
    assert ngram_join.all_shared(x, y).tolist() == want


def test_near_dedup_of_odd_rows(spark, odd):
    kept = ngram_join.near_dedup(odd)
    assert kept.columns == odd.columns
    # Empty sets stay; of equal sets the smallest id; the two copies of the long text are one component.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5]
    assert ngram_join.near_groups(numbered(odd.limit(0))).count() == 0


def test_tree_loses_nothing():
    draw = np.random.default_rng(2)
    points = draw.poisson(3, (300, ngram_join.GROUPS))
    points[150:] = np.maximum(points[:150] - (draw.random((150, ngram_join.GROUPS)) < 0.03), 0)
    sizes = points.sum(axis=1)
    found = set(zip(*(x.tolist() for x in ngram_join.RTree(points, sizes).search(points, sizes))))
    want = {(a, b) for a in range(300) for b in range(300) if np.minimum(points[a], points[b]).sum() >= ngram_join.need(sizes[a], sizes[b])}
    assert found == want


def test_written_tables_leave_no_shuffle_files(spark):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}
    before = files()
    held = [tie(spark.range(200).selectExpr("id a", "id + 1 b")), written(spark.range(200).groupBy(F.col("id") % 7).count(), "counts")]
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert held and not left


def test_tie(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (95, 100)], "a long, b long")
    roots = {r.id: r.root for r in tie(links).collect()}
    assert all(roots[k] == 0 for k in range(1, 41)) and roots[100] == roots[95] == 90


def distance(a, b):
    """Smallest edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_myers_against_the_table():
    draw = random.Random(1)
    for _ in range(60):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 90)))
        b = "".join(draw.choice("abc") for _ in range(draw.randrange(0, 120)))
        assert decontam.myers(a, b, 10**6)[0] == distance(a, b) if b else True


def test_contaminations(spark, odd):
    item = "The quick brown fox jumps over the lazy dog and runs away from all of the hunters in the wood."
    edited = item.replace("brown", "brawn").replace("lazy", "lzy")
    texts = [f"x {item.upper()}  y", f"before {edited} after", "the quick brown fox jumps over nothing", None, ""]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "  ")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.contaminations(documents(spark, texts), bench).collect())
    assert got == [(0, 7, 0), (1, 7, 2)]
    clean = decontam.decontaminate(documents(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert decontam.decontaminate(odd, bench.limit(0)).count() == 9


def test_language(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    rows = langid.identify(odd).collect()
    assert len(rows) == 9 and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert langid.accepted(odd).columns == odd.columns and langid.accepted(odd).count() == 5
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd.lang.substr(1, 0)).where("text is null")).collect()} == {"und"}


def test_backpropagation_has_the_right_slope():
    net = langid.Network(["a", "b"])
    codes = np.random.default_rng(0).integers(0, 256, (5, 3)).astype(np.uint8)
    layer = net.ahead
    for w in layer.weights():
        w += 0.3
    layer.inputs, layer.gates, layer.candidate = (w.astype(np.float64) for w in layer.weights())
    pull = np.random.default_rng(1).normal(size=(5, 3, langid.HIDDEN))
    trace: list = []
    layer.states(codes, trace)
    slopes = layer.backward(codes, trace, pull)
    for w, g in zip(layer.weights(), slopes):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        values = []
        for step in (1e-2, -2e-2):
            w[at] += step
            values.append(float((layer.states(codes) * pull).sum()))
        w[at] += 1e-2
        assert abs((values[0] - values[1]) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_field_marginals_against_all_paths():
    field = toxicity.Field({}, 0.0, -1.0, 0.3, 0.7, -0.5)
    e = np.array([0.4, -0.6, 1.2, 0.1])
    p = np.zeros(4)
    total = 0.0
    for path in itertools.product((0, 1), repeat=4):
        s = sum(v * y for v, y in zip(e, path)) + (-0.5 if path[0] else 0)
        s += sum({(0, 0): 0.0, (0, 1): -1.0, (1, 0): 0.3, (1, 1): 0.7}[pair] for pair in zip(path, path[1:]))
        total += np.exp(s)
        p += np.exp(s) * np.array(path)
    assert np.allclose(field.marginals(np.concatenate([e, e[:1]]), np.array([4, 1]))[:4], p / total)


def test_toxicity(spark, odd):
    draw = random.Random(3)
    clean = ["".join(draw.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    texts = [" ".join(draw.choices(clean, k=30)) + (" vile words" if k % 3 == 0 else "") for k in range(240)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)] + [(0, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in out if r.held_out) >= 0.95 * sum(r.held_out for r in out)
    spans = next(r.spans for r in out if r.doc_id == 3)
    assert "vile" in [texts[3][int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(","))]
    assert toxicity.train(odd, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert {r.score for r in toxicity.score(odd, toxicity.train(docs, labels)).where("doc_id < 3").collect()} == {0.0}


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>\n \\ |"), (1, 2, "assistant", None), (1, 2, "assistant", "tie"), (2, None, None, "no turn"), (None, 1, "user", "x")]
    turns += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " * 30) for k in range(40)] + [(4, 0, "assistant", "word " * 3000)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.windows(rows, budget=200, history=70)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = [(r or "", x or "") for c, t, r, x in turns if c == conv]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        said = "".join(x for r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    sizes = [sum(chat.count_tokens(x) for _, x in chat.parse(w.text)) for w in windows.where("conv_id = 3").collect()]
    assert len(sizes) > 5 and max(sizes) <= 200
    assert chat.windows(rows.limit(0)).count() == 0


def test_piece_encoding_is_the_models_own(spark, odd):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello world", "  two  spaces ", "tab\tand\nline", "naïve Ünïcode 漢字 \U0001f600", "12,345.67 x_y", "a" * 100, "²³. ½", "", None, LONG]
    docs = documents(spark, texts)
    for r in pieces.encoded(docs).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == own.encode(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [r.text for r in pieces.decode(pieces.encode(docs)).orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert pieces.encoded(odd).count() == 9


def test_joint_merges_follow_the_rule_of_one_unit(spark):
    model = pieces.read_model(open(pieces.MODEL, "rb").read())
    units, plain = pieces.Units(model, {}), pieces.Units(model, {})
    words = ["a", "▁the", "▁unbelievable", "aaaaaaa", "▁▁▁▁", "▁", "…—…", "▁Straßenbahn", "ñandú", "鿿x", "\n\n", "e" * 40, "e" * 41, "....!!"]
    words += ["▁" + "".join(random.Random(k).choices("aeionrstlch", k=1 + k % 18)) for k in range(3000)]
    got = units.learn(set(words))
    assert len(got) > 2500 and all(got[u] == plain[u] for u in got)
    short = [u for u in words[:60] if len(u) <= pieces.UNIT_CHARS]
    lattice = pieces.encode_units(spark.createDataFrame([(u,) for u in short], "unit string"), model).collect()
    assert {r.unit: tuple(r.ids) for r in lattice} == {u: plain[u] for u in short}
    assert not {"▁▁▁▁", "鿿x", "e" * 41} & set(got)
    assert units.learn(set()) == {} and [u for run in pieces.stretches(["ab", "", "abc", "d"], 3) for u in run] == ["ab", "", "abc", "d"]


def test_unigram_lattice(spark):
    model = pieces.Model(("<unk>", "▁ab", "▁a", "b", "bc", "c", "▁"), (0.0, -1.0, -1.5, -2.0, -1.2, -3.0, -2.5), (2, 1, 1, 1, 1, 1, 1), True, True)
    units = ["▁abc", "▁ab", "▁xb", "bcbc"]
    got = {r.unit: tuple(r.ids) for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    rule = pieces.Units(model, {})
    assert got == {u: rule[u] for u in units} and got["▁abc"] == (2, 4)


def test_warc_salvage(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(5, "http://a/\r\n", big), (3, None, big), (9, "u", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived(pages).collect()}
    assert got == {3: ("response", None, 203), 5: ("revisit", 3, 203), 9: ("revisit", 3, 203), 1: ("response", None, 4), 2: ("response", None, 4), 4: ("response", None, 0)}
    raw = [warc.record(k, "u", hashlib.sha256(b"body%d" % k).hexdigest(), 5, b"body%d" % k) for k in range(4)]
    for data in ([warc.member(r) for r in raw], raw):
        broken = data[0] + data[1][:30] + b"noise" + data[2] + data[3][:-9]
        rows = list(warc.salvage(broken))
        assert [r["page_id"] for r in rows if "page_id" in r] == [0, 2]
        gaps = [(r["start"], r["stop"]) for r in rows if "fault" in r]
        assert gaps[0] == (len(data[0]), len(data[0]) + 35) and gaps[1][1] == len(broken)
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_headers_of_any_length(spark, monkeypatch):
    big, url = "<p>" + "x" * 200, "http://a/" + "y" * 70_000
    pages = spark.createDataFrame([(1, url, big), (2, "u", big), (3, url, "tiny")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived(pages).collect()}
    assert got == {1: ("response", None, 203), 2: ("revisit", 1, 203), 3: ("response", None, 4)}
    raw = [warc.record(k, url, hashlib.sha256(b"body").hexdigest(), 4, b"body") for k in range(3)]
    for data in ([warc.member(r) for r in raw], raw):
        rows = list(warc.salvage(data[0] + data[1][:-9] + data[2]))
        assert [r.get("page_id") for r in rows] == [0, None, 2] and {r["url"] for r in rows if "url" in r} == {url}
    assert [warc._head(x, 0) for x in (b"WARC/2", b"WARC/1.1", b"WARC/1.1\r\na: b", b"WARC/1.1\r\na\r\n\r\n", b"WARC/1.1\r\n\r\n")] == ["version", "headers", "headers", "headers", "length"]
    whole = warc.read_archives
    for part in (lambda s, p: whole(s, p).where("page_id < 3"), lambda s, p: whole(s, p).withColumn("fault", F.when(F.col("page_id") == 3, "digest"))):
        monkeypatch.setattr(warc, "read_archives", part)
        with pytest.raises(ValueError, match="2 records"):
            warc.archived(pages)


def test_personal_data(spark, odd):
    texts = [
        "write to a.b@c.d.org or x@y@z.com, ip 1.2.3.4 and 1.2.3.999.5.6.7.8",
        "card 4111 1111 1111 1111 and 4111111111111112; call +1 (988) 555-2485 or +12",
        "my ssn is 123-45-6789 and phone 988-555-2485; mail jo [at] mail [dot] com",
        None,
        "é\U0001f600 a@b.co",
        "a.b@c.de_x@f.gh",
    ]
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def right(kind, hit):
        digits = [int(c) for c in hit if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    rows = {r.doc_id: r for r in pii.find(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = [f"{kind}:{m.start()}:{m.end()}" for kind, p in base for m in re.finditer(p, text or "") if right(kind, m.group())]
        assert rows[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(rows[k].spans.split(",")) | {""}
    assert "social_number:10:21" in rows[2].spans
    assert pii.find(odd).count() == 9 and pii.find(odd.limit(0)).count() == 0
    slow = documents(spark, ["a" * 200_000, "1." * 50_000, "x@" + "a." * 50_000, "9" * 200_000])
    assert pii.find(slow).count() == 4


def page(body, host="h.example"):
    return f"http://{host}/p", f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_main_text(spark):
    article = "<article><h1>Ti&amp;tle</h1><p><b>One\n two<br>three<p>Four<script>var x='</p>';</script><div class='comments'>no</div></article>"
    same = "<div class='top'>Same on all pages</div>"
    rows = [(1, *page(f"<nav>menu</nav>{article}<footer>f</footer>")), (2, "u", None), (3, None, ""), (4, "u", "plain &lt;text")]
    rows += [(10 + k, *page(f"{same}<div class='body'><p>Text number {k}.</p><p>More {k * k}</p></div><div class='ad'>buy {k}</div>", "s.example")) for k in range(6)]
    out = {r.page_id: r for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Ti&tle\n\nOne two three\n\nFour"
    assert (out[2].text, out[3].text, out[4].text) == ("", "", "plain <text")
    assert all(out[10 + k].text == f"Text number {k}.\n\nMore {k * k}" for k in range(6))
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_tree_judges_articles_too(spark):
    story = "A story of some length that all of these pages show again, word for word."
    rows = [(k, *page(f"<article><h1>Title {k}</h1><p>Story {k}.</p><div class='box'>From our staff</div></article>", "box.example")) for k in range(6)]
    rows += [(10 + k, *page(f"<div class='place'>Part {k}</div><article><p>{story}</p></article>", "copy.example")) for k in range(6)]
    rows += [(20 + k, *page(f"<div class='text'><p>{k} {story}</p></div><article class='card'><p>A teaser</p></article>", "card.example")) for k in range(6)]
    rows += [(30, *page(f"<div class='text'>{story}</div><article class='card'>A teaser</article>", "lone.example"))]
    out = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert out[k] == f"Title {k}\n\nStory {k}."
        assert out[10 + k] == f"Part {k}\n\n{story}"
        assert out[20 + k] == f"{k} {story}"
    assert out[30] == f"{story}\n\nA teaser"


@pytest.mark.parametrize(
    "body, kept",
    [
        ("<div class='layout with-sidebar'><p>a</p></div>", "a"),
        ("<div class='no-sidebar header-fixed'><article>a</article></div>", "a"),
        ("<div class='sidebar'><article>a</article>b</div>", "a"),
        ("<div id='comments'><main>a</main>b</div>", "a"),
        ("<div hidden><article>a</article></div>b", "b"),
        ("<nav><article>a</article></nav>b", "b"),
        ("<h2 id='related-work'>a</h2><h2 id='share-price'>b</h2><p id='binary-search'>c</p><h2 id='search'>d</h2>", "a b c d"),
        ("<div style='overflow:hidden'>a</div><p title='The hidden valley'>b<p aria-hidden='false'>c<p data-class=ad>d", "a b c d"),
        ("<p hidden>a<p HIDDEN=''>b<p class='x' hidden='until-found'>c<p title='x'hidden>d<p>e", "e"),
        ("<p data-id='x hidden' class=ad>a<p class='x' class='ad'>b<p title='role=menu'>c", "b c"),
        ("<div class='ad-banner'>a</div><div class='comment-list'>b</div><div class='siteHeader post'>c</div><div class='x ads'>d</div>e", "e"),
        ("<article>a<div class='comments'><article>b</article></div></article>", "a"),
    ],
)
def test_names_drop_nothing_else(body, kept):
    assert sitetree.main_text(page(body)[1], set()).split() == kept.split()


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "tokens"]
    out = corpus_pipeline.run(spark, FOLDER)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 0 < len(ids) < 200 and len(ids) == len(set(ids))


def test_one_tree_joins_many_cells(monkeypatch):
    """Cells of 1 to 700 rows: the pairs are those of brute force, and small cells share a call."""
    draw = np.random.default_rng(5)
    rows, want = [], set()
    for key, count in enumerate([1, 2, 3, 700, 17, 40] + [3] * 300):
        base = draw.poisson(2, 256)
        for i in range(count):
            counts = draw.poisson(2, 256) if i % 3 else np.maximum(base - (draw.random(256) < 0.05 * (i % 5)), 0)
            rows.append((key, 0, 0, 0, len(rows), len(rows) % 7, int(counts.sum()), b"1" + counts.astype(np.uint8).tobytes(), [], None))
    by_key: dict = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for cell in by_key.values():
        counts, size = np.stack([np.frombuffer(r[7][1:], np.uint8) for r in cell]).astype(int), np.array([r[6] for r in cell])
        for i, r in enumerate(cell):
            near = (np.minimum(counts, counts[i]).sum(axis=1) >= ngram_join.need(size, size[i])) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i]))
            want |= {(r[4], cell[j][4]) for j in np.flatnonzero(near) if j > i and cell[j][5] != r[5]}
    names = ["key", "lo", "hi", "own", "node", "root", "n", "vec", "before", "fine"]
    types = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    whole = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    trees: list = []
    tree = ngram_join.RTree.__init__
    monkeypatch.setattr(ngram_join.RTree, "__init__", lambda self, *a: (trees.append(1), tree(self, *a))[1])
    found = [ngram_join._near_pairs(t) for t in ngram_join._whole_cells(iter(whole.to_batches(max_chunksize=50)), ("key", "lo", "hi"))]
    assert {tuple(p) for part in found for p in part.tolist()} == want and len(want) > 1000 and len(trees) <= 2
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 30)
    found = [ngram_join._near_pairs(t) for t in ngram_join._whole_cells(iter(whole.to_batches(max_chunksize=50)), ("key", "lo", "hi"))]
    assert {tuple(p) for part in found for p in part.tolist()} == want
