"""Bounds, break-offs and the methods' inner parts, each against brute force or a planted case."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from terrace.llm import common, exact_dedup, language_id, linear, near_dedup, quality_crf, sentencepiece_codec, token_counts, warc
from terrace.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.01"


def test_a_sample_is_bounded_however_often_rows_repeat(spark):
    docs = spark.range(30000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    assert common.bounded_sample(docs, "lang", 200).count() <= 1
    other = docs.withColumn("text", F.monotonically_increasing_id().cast("string"))
    assert 100 < common.bounded_sample(other, "lang", 200).count() < 300
    labels = spark.createDataFrame([(7, 1)] * 50 + [(8, 0)], "doc_id long, quality int")
    assert common.labelled_sample(other, labels, "quality", 200).count() < 400


def test_kernel_svm_separates_and_agrees_with_its_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)).astype(np.float16)
    y = np.where(x[:, 0].astype(float) + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    products = linear.gram(x, 64)
    assert np.allclose(products, x.astype(np.float32) @ x.astype(np.float32).T + 1, atol=1e-3)
    w = linear.weigh(x, linear.linear_svm(products, y), 64)
    assert ((x.astype(float) @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


def test_language_columns_of_the_input_can_be_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(-7.0)).withColumn("lang_pred", F.lit("mine"))
    out = language_id.annotate(docs, to=("__l", "__s"))
    assert out.where("score = -7 and lang_pred = 'mine' and __s between 0 and 1 and __l is not null").count() == docs.count()


def test_one_row_of_equal_texts_is_kept(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (None, "a b"), (None, "z"), (None, "z"), (None, None), (3, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for text, keep, size in (("a b", 1, 4), ("z", None, 2), ("", 3, 2)):
        group = [r for r in got if r.text_sha256 == sha(text)]
        assert len(group) == size and {(r.keep_id, r.group_size) for r in group} == {(keep, size)} and sum(r.kept for r in group) == 1


def test_long_texts_are_hashed_in_parts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 1, 999, 1000, 5000, 5000)]
    texts.append(texts[-1].replace(" ", "  "))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = ({r.doc_id: (r.n_bytes, r.f1, r.f2, r.text_sha256) for r in exact_dedup.fingerprints(docs, k).collect()} for k in (1 << 20, 64))
    assert few == many and few[5] == few[6] and len(set(few.values())) == 6


class Broken(Exception):
    pass


def test_totals_survive_a_break_off_at_any_step(spark, tmp_path, monkeypatch):
    c = spark.createDataFrame([("s", "l", 5), ("s", None, 7)], "source string, lang string, n long")
    change = token_counts.change(c, "t", "n")
    write, delete = token_counts.Rollup._write, token_counts.Rollup._delete
    for step in range(12):
        roll, done = token_counts.Rollup(spark, str(tmp_path / f"r{step}")), []
        for b in ("a", "b", "c"):
            roll.commit(b, change)
        want = sorted(map(tuple, roll.totals().collect()), key=str)

        def breaking(run):
            def it(self, *args):
                if len(done) == step:
                    raise Broken
                done.append(1)
                return run(self, *args)

            return it

        monkeypatch.setattr(token_counts.Rollup, "_write", breaking(write))
        monkeypatch.setattr(token_counts.Rollup, "_delete", breaking(delete))
        try:
            roll.compact()
            roll.commit("d", change.limit(0))
            roll.compact()
            broke = False
        except Broken:
            broke = True
        monkeypatch.setattr(token_counts.Rollup, "_write", write)
        monkeypatch.setattr(token_counts.Rollup, "_delete", delete)
        again = token_counts.Rollup(spark, roll.path)
        assert sorted(map(tuple, again.totals().collect()), key=str) == want
        assert not again.commit("b", change)
        again.compact()
        assert sorted(map(tuple, again.totals().collect()), key=str) == want and not again.commit("a", change)
        if not broke:
            break
    assert step > 4


def test_a_long_chain_equals_all_labellings():
    rng = np.random.default_rng(0)
    doc = np.repeat([0, 1, 2, 3], [1, 5, 3, 6])
    first, last = quality_crf._ends(doc)
    emit, trans = rng.normal(0, 2, len(doc)), rng.normal(0, 1, (2, 2))
    good, pairs = quality_crf.chains(first, last, emit, trans)
    for d in range(4):
        at = np.flatnonzero(doc == d)
        total, one, two = 0.0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for z in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(emit[a] * k for a, k in zip(at, z)) + sum(trans[i, j] for i, j in zip(z, z[1:])))
            total, one = total + w, one + w * np.array(z)
            for t in range(1, len(at)):
                two[t, z[t - 1], z[t]] += w
        assert np.allclose(one / total, good[at]) and np.allclose(two[1:] / total, pairs[at][1:])
    n = 100_000
    ends = np.arange(n)
    good, _ = quality_crf.chains(ends == 0, ends == n - 1, np.where(ends % 1000 < 500, 2.0, -2.0), np.eye(2))
    assert good[100] > 0.9 and good[700] < 0.1 and np.isfinite(good).all()


def test_junk_lines_in_good_documents_are_found(spark):
    import pyarrow as pa
    from terrace.llm.textbytes import blocks

    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    model = quality_crf.fit(docs, labels)
    rows = docs.join(labels, "doc_id").select("text", "quality", "doc_id").collect()
    held = [r for r in rows if r.text and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    junk = [line for r in held if r.quality == 0 for line in r.text.split("\n") if line.count("!!") + line.count("***") + line.count("$$$") > 4]
    good = [r.text.split("\n") for r in held if r.quality == 1 and r.text.count("\n") > 6]
    assert junk and good
    planted, others = [], []
    for k, lines in enumerate(good):
        text = "\n".join([*lines[:3], junk[k % len(junk)], *lines[3:]])
        (_, block), *_ = blocks(pa.array([text]))
        doc, _, slots = quality_crf.line_features(block)
        p = model.lines(doc, slots)
        planted.append(p[3])
        others += [*p[:3], *p[4:]]
    assert np.mean(np.array(planted) < 0.5) > 0.9 and np.mean(np.array(others) < 0.5) < 0.1
    assert model.trans[0, 0] > model.trans[0, 1] and model.trans[1, 1] > model.trans[1, 0]


def test_verdict_of_the_quality_rules_on_held_out_labels(spark):
    """Labels of two thirds of the documents are given; the verdict is held against the others."""
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    from terrace.llm import quality_rules

    held = common.id_bucket("doc_id", 3) == 2
    got = quality_rules.quality_rules(docs, labels.where(~held)).join(labels.where(held), "doc_id").where("not base_failed").collect()
    right = [r.kept == (r.quality == 1) for r in got]
    assert len(right) > 40 and sum(right) >= 0.95 * len(right)


def test_records_are_rebuilt_byte_by_byte(spark, tmp_path):
    rows = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, None), (None, "u\nv", "short"), (5, "http://c", "x" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path))
    got = {r.page_id: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 3
    for page_id, url, html in rows:
        body, r = (html or "").encode(), got[page_id]
        kind = "revisit" if page_id in (1, 2) else "response"
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
        lines += [f"WARC-Target-URI: {url}".replace("\n", "%0A")] if url else []
        lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}"]
        lines += ["WARC-Refers-To: <urn:page:5>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else len(body)}", "", ""]
        assert bytes(r.record) == "\r\n".join(lines).encode() + (b"" if kind == "revisit" else body) + b"\r\n\r\n"
        assert bytes(r.payload) == body
    spark.read.parquet(f"{tmp_path}/payloads").withColumn("payload", F.lit("y").cast("binary")).write.parquet(f"{tmp_path}/bad/payloads")
    spark.read.parquet(f"{tmp_path}/headers").write.parquet(f"{tmp_path}/bad/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"{tmp_path}/bad").collect()


def test_unigram_paths_are_the_best_of_all():
    rng = random.Random(4)
    pieces = [("".join(p), -rng.random() * 4, i + 1) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", " ", " a"])]
    v = sentencepiece_codec.Vocabulary.of(pieces, list(range(20, 276)), 300, merges=False)
    score = {t: s for t, s, _ in pieces}

    def best(text):
        found = {0: (0.0, ())}
        for end in range(1, len(text) + 1):
            options = [(found[at][0] + score[text[at:end]], (*found[at][1], text[at:end])) for at in range(end) if text[at:end] in score]
            found[end] = max(options)
        return found[len(text)]

    lanes = sentencepiece_codec.Lanes(v)
    for _ in range(100):
        text = " " + "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        search = sentencepiece_codec.Viterbi(v, lanes.trie)
        got = [p for k in range(0, len(text), 3) for p in search.feed(text[k : k + 3])] + search.finish()
        of = {k: t for t, _, k in pieces}
        assert abs(sum(score[of[k]] for _, k in got) - best(text)[0]) < 1e-9 and sum(n for n, _ in got) == len(text)
        flat, _ = lanes.encode([text[1:]])
        assert abs(sum(score[of[k]] for k in flat.tolist()) - best(text)[0]) < 1e-9


def test_parity_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(5)
    item = rng.integers(0, 2**63, 300).astype(np.uint64)
    for _ in range(30):
        a, b = (rng.integers(0, 3, 300) for _ in range(2))
        doc, items, weight = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]), np.concatenate([item[a > 0], item[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])
        x, y = near_dedup.parities(doc, items, weight, 2).view(np.uint64)
        assert np.bitwise_count(x ^ y).sum() <= np.abs(a - b).sum()
        assert not (x ^ near_dedup.parities(doc, items, weight, 2).view(np.uint64)[0]).any()


def _sketch_pairs():
    """Two sketches each of texts of 100 to 9000 shingles, and how many shingles only one of the two has."""
    rng, rows = np.random.default_rng(6), []
    for size, grown in ((100, 110), (1000, 1240), (1020, 1030), (4000, 4200), (9000, 9000)):
        item = rng.integers(0, 2**63, grown + size // 10).astype(np.uint64)
        items = np.concatenate([item[:size], item[-grown:]])
        doc = np.repeat([0, 1], [size, grown])
        order = np.lexsort((items, doc))
        both = near_dedup.sketches(doc[order], items[order], np.ones(len(items), int), 2).to_pylist()
        assert all(64 * len(x) >= 2 * n for x, n in zip(both, (size, grown)))
        rows.append((*both, 2 * len(item) - size - grown))
    return rows


def test_sketches_of_any_length_bound_the_difference_from_below(spark):
    """Compared in Spark, each longer one folded onto the shorter."""
    rows = _sketch_pairs()
    assert len({len(r[0]) for r in rows}) > 2 and any(len(r[0]) != len(r[1]) for r in rows)
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, most int").select(near_dedup._flips("a", "b"), near_dedup._flips("b", "a"), "most").collect()
    assert all(f == back and most / 2 < f <= most for f, back, most in got)


def test_long_texts_below_the_threshold_are_not_all_compared(spark, monkeypatch):
    """A family of 60 texts of 3000 words, all too different but for one pair; few of the 1770 pairs come to be compared,
    none twice, and the pair is found."""
    rng, texts, base = random.Random(21), [], [f"w{i}" for i in range(3000)]
    for m in range(60):
        own = texts[0].split() if m == 1 else list(base)
        for k in rng.sample(range(0, 3000, 5), 2 if m == 1 else 42):
            own[k] = f"m{m}k{k}"
        texts.append(" ".join(own))
    sets = [set(zip(*(w[k:] for k in range(5)))) for w in map(str.split, texts)]
    links = {(a, b) for b in range(60) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    made, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest: made.extend((min(r), max(r)) for r in pairs.select("node", "leader").collect()) or verified(pairs, *rest))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rows=1).collect()}
    assert links == {(0, 1)} and {d for d, c in got.items() if d != c} == {1}
    assert len(made) == len(set(made)) and len(made) < 600


def test_recall_in_a_large_group_of_near_copies(spark):
    """A family of 300 copies, each with some words changed: every link of 0.8 or more must be inside a class."""
    rng, texts = random.Random(8), []
    base = [f"w{i}" for i in range(200)]
    for _ in range(300):
        own = list(base)
        for k in rng.sample(range(200), rng.randint(0, 5)):
            own[k] = f"x{rng.random()}"
        texts.append(" ".join(own))
    sets = [set(zip(*(w[k:] for k in range(5)))) for w in map(str.split, texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    links = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) > 1000 and all(got[a] == got[b] for a, b in links)


def test_one_row_of_a_class_stays_whatever_the_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (1, long, "b"), (None, long, "c"), (None, "other text of some words here", "d"), (None, "other text of some words here", "d"), (1, "a third text that stands alone", "e"), (9, "", "f"), (9, "", "f"), (8, None, "g")]
    got = sorted((r.text or "", r.doc_id or 0) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, __n string")).collect())
    assert got == sorted([(long, 1), ("other text of some words here", 0), ("a third text that stands alone", 1), ("", 9), ("", 9), ("", 8)])


def test_pipeline_on_empty_tables_and_clashing_names(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumns({c: F.lit(-7.0) for c in ("score", "deleted_lines", "__runs", "size", "target", "class_id")}).withColumn("lang_pred", F.lit("mine"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns, name
        assert out.where("score <> -7 or deleted_lines <> -7 or __runs <> -7 or size <> -7 or target <> -7 or class_id <> -7 or lang_pred <> 'mine'").isEmpty(), name
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_keep_values_on_odd_rows(spark, tmp_path):
    """Repeated rows, null ids and a long text: the defined results, by value."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, text, None, None), (2, None, "en", "s"), (3, "", "en", None), (4, "7 8 9", "en", "s"), (5, "a" * 70000, "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    q = {k: QUERIES[k](spark, str(tmp_path)).collect() for k in ("op1_language_id", "op4_line_dedup", "op7_quality_rules", "op8_quality_classifier", "op10_mixing")}
    assert {(r.doc_id, r.lang_pred) for r in q["op1_language_id"] if r.doc_id in (2, 3, 4)} == {(2, "und"), (3, "und"), (4, "und")}
    assert sorted(r.deleted_lines for r in q["op4_line_dedup"] if r.doc_id != 1) == [0, 0, 0, 0, 1]
    assert {(r.doc_id, r.n_words, r.base_failed) for r in q["op7_quality_rules"]} == {(1, 80, False), (None, 80, False), (2, 0, True), (3, 0, True), (4, 3, True), (5, 1, True)}
    assert {r.predicted for r in q["op8_quality_classifier"]} == {1} and len(q["op8_quality_classifier"]) == 7
    assert {(r.doc_id, r.size) for r in q["op10_mixing"]} == {(1, 80), (None, 80), (2, 0), (3, 0), (4, 3), (5, 1)}


def test_language_fit_holds_its_sample_once(spark, monkeypatch):
    import pyarrow as pa

    from terrace.llm import language_id

    seen, gram = [], language_id.gram

    def spy(x):
        seen.append((pa.total_allocated_bytes(), x.nbytes))
        return gram(x)

    monkeypatch.setattr(language_id, "gram", spy)
    rows = [(i, f"{w} {i} {w} words {i * 7}", lang) for i in range(60) for w, lang in (("the", "en"), ("der", "de"))]
    before = pa.total_allocated_bytes()
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families == [["de", "en"]]
    (held, size), = seen
    assert size >= 100 * 2 * language_id.DIMS and held - before < size / 2


def test_pipeline_encodes_in_small_batches(spark):
    """10,000 rows of long texts in an Arrow batch were held by the JVM and by each worker; the last stage writes its rows with small ones."""
    pipeline = pytest.importorskip("corpus_pipeline")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    out = pipeline.encode_pieces(spark, docs, "")
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and out.where("exact and n_ids > 0").count() == 1200
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_texts_encoded_together_take_bounded_memory():
    import tracemalloc

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(150)) for _ in range(1600)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = [p.column(0) for p in sentencepiece_codec._batches(batch, np.array([len(t) for t in texts]))]
    assert [t for p in parts for t in p.to_pylist()] == texts
    lanes = sentencepiece_codec.Lanes(sentencepiece_codec.Vocabulary.load())
    tracemalloc.start()
    sentencepiece_codec._ids_of(lanes, parts[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
