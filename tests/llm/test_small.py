"""Each operator against brute force, and nulls, empties, repeats and clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import chat, common, decontaminate, editcount, encode, linededup, mixing, neardup, pages, quality, sstable, toxicity
from wayfold.llm.queries import QUERIES, tokenizer_path

ODD = [(1, None, "en", "s"), (2, "", None, None), (3, "a b c\nd e\nf\ng", "en", "s"), (3, "a b c\nd e\nf\ng", "en", "s"), (None, "x " * 20000, "en", None), (5, "q\nd e\nf\ng", "de", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({"size": F.lit("x"), "h": F.lit(1), "target": F.lit(2), "_text": F.lit("t"), "v": F.lit(0)})


@pytest.fixture(scope="module")
def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_quality_odd_rows(odd, empty_labels):
    got = quality.judge(odd, empty_labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].n_words == 0 and not by[1].kept and by[2].stratum is None
    assert by[None].n_words == 20000 and by[None].n_repeat_words == 20000 and by[None].base_failed
    assert by[3].word_chars == 7 and by[3].n_lines == 4
    assert quality.judge(odd.limit(0), empty_labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    for n, x in ((10, 0), (300, 3), (5000, 40)):
        want = sum(comb(n, k) * 0.02**k * 0.98 ** (n - k) for k in range(x + 1)) if n < 1000 else None
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(x).cast("long"), 0.02)).first()[0]
        assert 0 <= got <= 1 and (want is None or abs(got - want) < 1e-9 * max(want, 1e-300) + 1e-12)


def test_certified_cutoffs_limit_false_rejections(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["word%d" % rng.randrange(10**6) for _ in range(30)] + ["#" * (20 if i % 50 == 0 else 0)]), "en") for i in range(1500)]
    bad = [(10000 + i, " ".join("w%d***" % rng.randrange(10**6) for _ in range(30)), "en") for i in range(100)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(10000 + i, 0) for i in range(100)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert sum(not r.kept for r in got if r.doc_id < 10000) <= 0.04 * 1500
    assert not any(r.kept for r in got if r.doc_id >= 10000)


def test_certified_cutoffs_reject_at_small_scale(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.features(docs).cache()
    found = {r.stratum: r for r in quality.thresholds(rows, labels).collect()}
    # en alone has labels enough; a certificate rests on the stratum's own good labels
    assert set(found) == {"en"} and found["en"].n_good > 108 and found["en"].n_caught > 0
    got = quality.judge(docs, labels).collect()
    assert any(not r.kept and not r.base_failed and r.stratum == "en" for r in got)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert sum(not r.kept and not r.base_failed for r in got if r.doc_id in good) <= 0.04 * len(good)


def test_small_strata_lose_no_good_documents(spark):
    # c's two good documents fail rules that its own labels can't certify; a and b alone would certify them
    rows = [(1000 * k + i, " ".join("%sword%d" % (lang, 37 * i + j) for j in range(30)), lang) for k, lang in enumerate("ab") for i in range(150)]
    rows += [(5000 + i, " ".join("c%d***" % (37 * i + j) for j in range(30)), "c") for i in range(2)]
    rows += [(6000 + 1000 * k + i, " ".join("x%d***" % (37 * i + j) for j in range(30)), lang) for k, lang in enumerate("abc") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 6000)) for r in rows], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    assert {r[0] for r in rows if r[0] < 6000} <= kept
    assert not any(6000 <= i < 8000 for i in kept) and all(8000 + i in kept for i in range(20))


def test_line_dedup_odd_rows(odd):
    got = {(r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(odd).collect()}
    assert (1, None, 0) in got and (2, "", 0) in got and (3, "a b c\nd e\nf\ng", 0) in got and (5, "q", 3) in got
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 6 and {r.doc_id for r in got if r.size == 0} == {1, 2}
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target) and all(r.taken <= 3 * r.size for r in mine)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in got]), np.array([r.score for r in got])
    auc = (s[y == 1][:, None] > s[y == 0]).mean()
    assert auc > 0.95 and all(0 <= x <= 1 for x in s)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)


def test_toxicity_odd_rows(odd, empty_labels):
    got = toxicity.classify(odd, empty_labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    clash = odd.withColumns({"score": F.lit("mine"), "flagged": F.lit("own"), "i": F.lit(1), "copy": F.lit(2), "id": F.lit(3), "v_": F.lit(4)})
    kept = toxicity.clean(clash, empty_labels)
    assert kept.columns == clash.columns and all(r.score == "mine" and r.flagged == "own" for r in kept.collect())
    assert toxicity.classify(odd.limit(0), empty_labels).count() == 0
    assert neardup.dedup(clash).columns == clash.columns and {r.doc_id for r in neardup.dedup(clash).collect()} == {1, 3, None, 5}
    assert mixing.mixed(clash).columns == clash.columns and all(r.copy == 2 and r.i == 1 for r in mixing.mixed(clash).collect())
    bench = odd.sparkSession.createDataFrame([(1, "x " * 30)], "item_id long, text string")
    assert decontaminate.clean(clash, bench).columns == clash.columns and {r.doc_id for r in decontaminate.clean(clash, bench).collect()} == {1, 2, 3, 5}


def test_chat_recovers_roles(spark):
    got = QUERIES["op4_chat_formatting"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.n_right for r in held) > 0.9 * sum(r.n_lines for r in held)


def test_chat_odd_rows(spark):
    model = chat.fit(chat.transcribe(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Human: hi?\nmore\n\n[ASSISTANT] yes."), (3, "no marker at all")], "id int, text string")
    got = {(r.id, r.rendered) for r in chat.parse(rows, model).collect()}
    assert (1, "") in got and (2, "") in got and (3, "<|user|>\nhi?\nmore\n<|assistant|>\nyes.\n") in got
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, 600, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.part, r.n_turns) for r in chat.transcribe(turns).collect()} == {(1, 0, 1), (1, 1, 1), (None, 0, 1)}


def test_chat_parts_are_one_transcript(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat.fit(chat.transcribe(turns))
    found = {}
    for most in (512, 2, 1):
        made = chat.transcribe(turns, most_turns=most).withColumn("id", F.struct("conv_id", "part")).cache()
        rows = sorted(chat.parse(made, model, series=F.col("conv_id"), part=F.col("part")).collect(), key=lambda r: (r.id.conv_id, r.id.part))
        assert most > 2 or len(rows) > len({r.id.conv_id for r in rows})
        found[most] = {}
        for r in rows:
            text, states = found[most].get(r.id.conv_id, ("", []))
            # the blank line between parts goes on with the line before
            found[most][r.id.conv_id] = text + r.rendered, states + r.states
        found[most] = {k: (t, [x // 2 for x in s if x % 2 == 0]) for k, (t, s) in found[most].items()}
    assert found[512] == found[2] == found[1]
    assert chat.parse(chat.transcribe(turns.limit(0)).withColumn("id", F.lit(1)), model).count() == 0
    long = spark.createDataFrame([(1, "Human: hi\n" * 20_000, 3)], "id int, text string, k int")
    assert len(chat.parse(long, model).first().states) == 20_001


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    m = chat.Model(rng.random(6) * 5, rng.random((6, 6)) * 5, rng.random((6, chat.N_SYMBOLS)) * 5)
    obs = rng.integers(0, chat.N_SYMBOLS, 4)
    import itertools

    def score(p):
        return m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:])) + sum(m.emit[s, o] for s, o in zip(p, obs))

    assert np.isclose(score(m.viterbi(obs)), max(score(p) for p in itertools.product(range(6), repeat=4)))


PAGE = """<html><head><title>x</title></head><body><header><a>Home</a></header><div class="cookie-notice">We use cookies</div><main>
<article class="post"><header><h1>Title &amp; co</h1></header><p>One<br>two <i>three</i><p>Four &lt;b&gt;<ul><li>a<li>b</ul>
<div class=comments><p>troll</p></div><aside>side</aside><form>in</form>tail</article></main><div id="comments">c</div><footer>f</footer><script>if(a<b)"</p>"</script>"""


def test_pages(spark):
    assert [t for t, _, _ in pages.parsed(PAGE)[0]] == ["Title & co", "One two three", "Four <b>", "a", "b", "tail"]
    assert pages.main_text(PAGE, set())[0] == "Title & co\n\nOne two three\n\nFour <b>\n\na\n\nb\n\ntail"
    same = "<div><p>Sign up today</p></div>"
    # changing links in an unmarked list: only the skeleton recurs
    links = lambda i: "<div class=x><ul>%s</ul></div>" % "".join(f"<li><a href=/{i}>link {i} {k}</a>" for k in range(2 + i % 3))
    rows = [(i, "http://h.example/%d" % i, f"<body>{links(i)}{same}<div><p>Text {i} is as long as needed to be most of a page, and is not like the others {i * 7}</p></div></body>") for i in range(3)]
    rows += [(90, None, None), (90, "", ""), (91, "http://o.example/", f"<body>{same}</body>")]
    rows += [(100 + i, f"http://copy.example/{i}", "<body><div><p>The same article everywhere</p><p>and its end</p></div></body>") for i in range(3)]
    rows += [(200 + i, f"http://big.example/{i}", f"<body><article><p>Own words {i} and many more of them, so that the page is its own</p><p>{'Shared' if i % 2 else 'Often'}</p></article></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "gone": F.lit(2), "text": F.lit(3)})
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for i in range(3):
        assert got[i].text.startswith(f"Text {i} is") and "\n" not in got[i].text and got[i].n_template == 2 and got[i].n_removed == 3 + i % 3, got[i]
        assert got[100 + i].text == "The same article everywhere\n\nand its end"
    assert got[90].text == "" and got[91].text == "Sign up today" and got[91].n_chars == 13
    assert all(got[200 + i].text.endswith("Shared" if i % 2 else "Often") for i in range(12))
    assert pages.extract(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://h/", "<p>" + "word <b>x</b> " * 100_000)], "page_id long, url string, html string")
    assert pages.extract(long).first().n_chars == 7 * 100_000 - 1


def test_template_counts_by_brute_force(spark):
    from collections import defaultdict
    from urllib.parse import urlsplit

    rows = [(urlsplit(r.url).hostname, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    on, pages_of = defaultdict(int), defaultdict(int)
    for host, html in rows:
        pages_of[host] += 1
        for key in {x for t in pages.parsed(html)[1].values() for x in pages._keys(t)}:
            on[host, key] += 1
    want = {(h, k) for (h, k), n in on.items() if n >= 2 and (n >= 0.9 * pages_of[h] and n > 3 if k[0] == pages.INSIDE else n >= 0.3 * pages_of[h])}
    found = pages.template(spark.createDataFrame(rows, "host string, html string")).collect()
    assert want and {(r.host, (k.kind, k.h)) for r in found for k in r.gone} == want


def test_encoder_equals_tokenizer():
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), encode.Encoder(path, bits=8, longest=4)
    texts = ["Hello, it's ΣΑΣ İstanbul x　y  1234 don't!!", "é ́x <|endoftext|> a<|startoftext|>b", "", None, "\x1c\x85 tab\tq\r\nz", "naïve 中文 字 🙂🙂 ﬁ ½ _a_ 'LL", "ß ẞ ǅ ʼn", "x" * 3000 + " y", " \n "]
    whole = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    for some in (texts, whole, texts, ["only"], []):
        ids, first = e.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_shards_round_trip(spark, odd):
    from pyarrow import fs
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(-5, "neg"), (10**15, None), (None, "none"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = sstable.write(df, tokenizer=path, block_bytes=2048, shard_bytes=20_000).cache()
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.digest(made).collect()))
    ids = {(d, x): t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows}
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    assert sorted((d is not None, d or 0, len(ids[d, x]), crc(ids[d, x])) for d, x in rows) == sorted((d is not None, d or 0, n, c) for _, d, n, c in got)
    at, last = 0, None
    for start, d, n, _ in got:
        assert start == at and (last is None or d is None or d >= last)
        at, last = at + n, d
    manifest = made.orderBy("start").collect()
    assert len(manifest) > 3
    system, name = fs.FileSystem.from_uri(manifest[-1].path)
    with system.open_input_file(name) as f:
        shard = sstable.Shard(f)
        key, value = next(iter(shard))
        assert any(np.array_equal(x, np.frombuffer(value, "<u2")) for x in shard.get(sstable.id_of(key))) and shard.get(-77) == []
        assert sum(shard.may_have(k) for k in range(10**7, 10**7 + 2000)) < 60
    for want in {d for d, _ in rows[:20]} | {None, 7, -5, 10**15}:
        assert sorted(x.tolist() for x in sstable.get(made, want)) == sorted(ids[d, x] for d, x in rows if d == want)
    assert sstable.get(made, -77) == []
    long = spark.createDataFrame([(1, "one two " * 200_000, 3)], "doc_id long, text string, tie int").withColumns({"path": F.lit("p"), "first": F.lit("f")})
    assert [(r.n_tokens, r.start) for r in sstable.digest(sstable.write(long, tokenizer=path)).collect()] == [(400_001, 0)]
    assert sstable.digest(sstable.write(odd.limit(0), tokenizer=path)).count() == 0


def test_edit_counts(spark, odd):
    code = editcount.tokenizer(tokenizer_path("byte_bpe_50k.tiktoken"))
    count, r = editcount.Counter(code, most=50), random.Random(1)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + ["", "a", " ", "  a b", "it's  'll\n\n x"] * 5
    for x in texts:
        leaf = r.choice([8, 60, 512])
        tree, now = editcount.Tree.of(x, count, leaf), x
        assert tree.total == len(code.encode_ordinary(x))
        for _ in range(6):
            at, gone, new = r.randrange(len(now) + 2), r.choice([0, 1, 3, 40]), r.choice(["", " ", "x", "  ", "\n", "'s t", " word", "a b c d e f " * 9])
            tree.edit(at, gone, new, count)
            a = min(at, len(now))
            now = now[:a] + new + now[a + gone :]
            assert "".join(tree.texts) == now and tree.total == len(code.encode_ordinary(now))
            assert tree.sums[1] == tree.sums[tree.size :].sum()
            assert all(tree.sums[k] == tree.sums[2 * k] + tree.sums[2 * k + 1] for k in range(1, tree.size))
            tree = editcount.Tree(list(tree.texts), tree.sums.copy(), leaf)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    edits = editcount.sample_edits(F.col("n_chars"), F.get("leaves", F.lit(0)))
    got = editcount.edit(editcount.build(odd, tokenizer_path=path), edits, tokenizer_path=path).collect()
    assert len(got) == 6 and {r.n_before for r in got if r.doc_id in (1, 2)} == {0}
    none = F.lit(None).cast("array<struct<at: bigint, removed: bigint, inserted: string>>")
    assert all(r.n_tokens == r.n_before and r.n_encoded == 0 for r in editcount.edit(editcount.build(odd, tokenizer_path=path), none, tokenizer_path=path).collect())
    assert editcount.edit(editcount.build(odd.limit(0), tokenizer_path=path), edits, tokenizer_path=path).count() == 0


def test_edit_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    code = editcount.tokenizer(tokenizer_path("byte_bpe_50k.tiktoken"))
    count = lambda x: len(code.encode_ordinary(x))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x = r.text or ""
        n, now = len(x), x
        for at, gone, new in ((n // 3, 17, ""), (n * 2 // 3, 0, x[:40]), (max(n - 5, 0), 9, " the  end.\n")):
            at = min(at, len(now))
            now = now[:at] + new + now[at + gone :]
        want[r.doc_id] = (count(x), count(now), len(now))
    got = QUERIES["op9_edit_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in got} == want
    assert sum(r.n_encoded for r in got) < sum(r.n_leaves for r in got)


def brute_tiles(a, b, least):
    """Greedy string tiling as defined: the longest unmarked common run, first in b, then in a; until none of ``least``."""
    fa, fb, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        covered += n
        fa[i : i + n] = [False] * n
        fb[j : j + n] = [False] * n


def test_tiles():
    r = random.Random(2)
    for _ in range(60):
        a, b = [r.randrange(4) for _ in range(r.randrange(30))], [r.randrange(4) for _ in range(r.randrange(18))]
        assert decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute_tiles(a, b, 3), (a, b)


def test_tile_of_one_word_throughout():
    assert decontaminate.tile(np.full(300_000, 7, np.uint64), np.full(200, 7, np.uint64), 5) == 200
    assert decontaminate.tile(np.full(300, 7, np.uint64), np.full(2000, 7, np.uint64), 5) == 300


def test_decontamination_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    words = lambda x: "".join(c if c.isalpha() or c.isnumeric() else " " for c in (x or "").lower()).split()
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for i, b in items.items():
        seeds = {tuple(b[k : k + 5]) for k in range(len(b) - 4)}
        for d, a in docs.items():
            near = sorted({k + x for k in range(len(a) - 4) if tuple(a[k : k + 5]) in seeds for x in range(5)})
            if near:  # only what lies in shared seeds can be under tiles; a gap stays a gap
                cut = [x for k, p in enumerate(near) for x in ([None, a[p]] if k and near[k - 1] != p - 1 else [a[p]])]
                n = brute_tiles(cut, b, 5)
                if n >= 0.5 * len(b):
                    want.add((d, i, n, len(b)))
    got = {(r.doc_id, r.item_id, r.covered, r.item_words) for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    assert want and got == want


def test_leaks(spark, odd):
    rng = random.Random(5)
    item = ["w%d" % rng.randrange(10**6) for _ in range(30)]
    other = ["z%d" % rng.randrange(10**6) for _ in range(100)]
    moved = other[:20] + item[15:] + other[20:40] + item[:15]
    rows = [(1, " ".join(other)), (2, " ".join(moved)), (3, " ".join(x.upper() + "," for x in other[:9] + item + other[50:])), (4, " ".join(other + item[:10])), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("c"))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = {(r.id, r.item_id, r.covered) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(2, 7, 30), (3, 7, 30)}
    short = spark.createDataFrame([(1, "w%d z1 z2" % 1), (2, "one two"), (2, None)], "item_id long, text string")
    some = spark.createDataFrame([(1, "there is One, two!"), (1, "there is One, two!"), (2, "one or two"), (3, "one two " * 50_000)], "doc_id long, text string")
    assert sorted((r.id, r.item_id, r.covered) for r in decontaminate.leaks(some, short).collect()) == [(1, 2, 2), (3, 2, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 4, 5, 6]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(odd.limit(0), bench).count() == 0


def test_a_common_sentence_makes_no_pairs(spark, monkeypatch):
    seen = {}
    keep = common.Scratch.staged
    monkeypatch.setattr(common.Scratch, "staged", lambda self, df, tag: seen.setdefault(tag, keep(self, df, tag)))
    monkeypatch.setattr(common.Scratch, "drop", lambda self, but=(): None)
    common_words = " ".join("common%d" % i for i in range(12))
    own = lambda kind, i, n: " ".join("%s%dx%d" % (kind, i, j) for j in range(n))
    bench = [(i, own("item", i, 20) + " " + common_words) for i in range(300)]
    docs = [(i, own("doc", i, 30) + " " + common_words + " " + own("more", i, 30)) for i in range(300)]
    docs += [(1000 + i, bench[i][1] if i % 2 else own("item", i, 20)) for i in range(10)]  # leaks with and without the sentence
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.id, r.item_id, r.covered) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1000 + i, i, 32 if i % 2 else 20) for i in range(10)}
    assert seen["candidates"].count() == 10


def test_telling_seeds_find_every_leak(spark):
    """Items of few words, that share much, at several thresholds: the same pairs as when all pairs are tiled."""
    rng = random.Random(11)
    text = lambda n: " ".join("w%d" % rng.randrange(4) for _ in range(n))
    shared = [text(8) for _ in range(3)]
    make = lambda: " ".join(rng.choice([text(rng.randrange(1, 7)), rng.choice(shared)]) for _ in range(rng.randrange(1, 5)))
    docs, bench = [(i, make()) for i in range(60)], [(i, make()) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for threshold in (0.3, 0.5, 0.9, 1.0):
        want = set()
        for i, x in bench:
            y = x.split()
            size = min(5, len(y))
            seeds = {tuple(y[k : k + size]) for k in range(len(y) - size + 1)}
            for j, t in docs:
                a = t.split()
                under = {k + n for k in range(len(a) - size + 1) if tuple(a[k : k + size]) in seeds for n in range(size)}
                n = brute_tiles([w if k in under else None for k, w in enumerate(a)], y, size) if under else 0
                if n >= threshold * len(y):
                    want.add((j, i, n))
        got = {(r.id, r.item_id, r.covered) for r in decontaminate.leaks(d, b, threshold=threshold).collect()}
        assert want and got == want, threshold


def test_word_hashes_are_by_word(spark):
    import pyarrow as pa

    h, first = common.text_words(pa.array(["a bb a", None, "", " \n", "bb", "éé x" * 5000]))
    assert first[:6].tolist() == [0, 3, 3, 3, 3, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_mixing_ranges_are_even_for_low_weights_and_repeats(spark, monkeypatch):
    seen = {}
    keep = common.staged
    monkeypatch.setattr(common, "staged", lambda df, tag: seen.setdefault(tag, keep(df, tag)))
    # one source of weight 10 throughout, half of its rows alike in id and text
    docs = spark.range(8000).select(F.when(F.col("id") < 4000, F.lit(1)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("## # ### ##### a b c").alias("text"), F.lit("s").alias("source"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = mixing.mix(docs)
        assert got.agg(F.sum("taken")).first()[0] == int(got.first().target)
        sizes = [r["count"] for r in seen["ranges"].groupBy("_part").count().collect()]
        assert sum(sizes) == 8000 and len(sizes) == 16 and max(sizes) < 2 * 8000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
