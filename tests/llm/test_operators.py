"""The ten operators and the pipeline against brute force, the library itself, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from terrace.llm import exact_dedup, line_dedup, mixing, near_dedup, queries, sentencepiece_codec, token_counts
from terrace.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
_WORDS = ["".join(random.choice("etaoinshr") for _ in range(6)) for _ in range(900)]
_BASE = " ".join(random.sample(_WORDS, 120))
TEXTS = [None, "", " \n\t", "one", "x " * 60, _BASE, _BASE + " ", _BASE.replace(" ", "\n"), _BASE.replace(_BASE.split()[5], "changed"), "日本語 ▁ 🙂\x00é", "a" * 70000, *[" ".join(random.sample(_WORDS, 80)) for _ in range(20)]]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids int, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 1, 0.5, 7, "r") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, _BASE, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def odd_dir(odd, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, None if i == 2 else f"http://a/{i}\n", t) for i, t in enumerate(TEXTS)] + [(None, "u", _BASE), (50, "u", _BASE)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    turns = [(i // 3, i, ["user", None, "assistant", "system", ""][i % 5], t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame([(*r, 1, "x") for r in [*turns, turns[5], (None, None, None, None), (None, None, "user", "hi.")]], "conv_id long, turn long, role string, text string, pos int, conv string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_and_empty_tables(spark, odd_dir, tmp_path, name):
    got = QUERIES[name](spark, odd_dir).count()
    if name == "op11_conversation_repair":
        assert got == (len(TEXTS) + 2) // 3 + 1
    elif name not in ("op3_token_counts", "op6_warc", "op13_collocations"):
        assert got == len(TEXTS) + 2
    for t in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_fingerprints_compose_and_collisions_are_told_apart(spark, odd):
    chunk = b"some bytes to hash, in two parts"
    for k, (prime, _) in enumerate(exact_dedup.MODULI):
        assert exact_dedup.combine([exact_dedup.chunk_hash(chunk[:9])[k], exact_dedup.chunk_hash(chunk[9:])[k]], prime) == exact_dedup.chunk_hash(chunk)[k][0]
    weak = ((7, 3), (5, 2))  # nearly all fingerprints of one length collide
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, 16, weak).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(TEXTS)}
    for i, t in norm.items():
        same = [k for k, v in norm.items() if v == t]
        assert (got[i].keep_id, got[i].group_size, got[i].text_sha256) == (min(same), len(same), hashlib.sha256(t.encode()).hexdigest())


def test_token_counts_equal_a_direct_count(spark, tmp_path):
    import tiktoken

    bpe = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts._ranks(token_counts.RANKS), special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = WORD.findall(r.text or "")
        for version, n in ((token_counts.WORDS, len(words)), (token_counts.BPE, len(bpe.encode_ordinary(r.text or "")))):
            if words:
                want[r.source, r.lang, version][0] += 1
                want[r.source, r.lang, version][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert got == dict(want)


def test_token_counts_cover_rows_without_a_word(spark, odd, odd_dir):
    import tiktoken

    bpe = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts._ranks(token_counts.RANKS), special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for r in odd.collect():
        for version, n in ((token_counts.WORDS, len(WORD.findall(r.text or ""))), (token_counts.BPE, len(bpe.encode_ordinary(r.text or "")))):
            want[r.source, r.lang, version][0] += 1
            want[r.source, r.lang, version][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in QUERIES["op3_token_counts"](spark, odd_dir).collect()}
    assert got == dict(want)


def test_replays_and_compaction_change_nothing(spark, tmp_path):
    c = spark.createDataFrame([("s", None, 5), ("s", None, 7)], "source string, lang string, n long")
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    assert roll.commit("a", token_counts.change(c, "t", "n")) and not roll.commit("a", token_counts.change(c, "t", "n"))
    assert roll.commit("b", token_counts.change(c.limit(1), "t", "n", -1)) and roll.commit("empty", token_counts.change(c.limit(0), "t", "n"))
    before = roll.totals().collect()
    assert before[0].n_docs == 1
    roll.compact()
    assert not roll.commit("b", token_counts.change(c, "t", "n"))
    assert roll.totals().collect() == before


def _deleted(docs, least):
    """Lines (with words) that lie in a run of ``least`` words with an earlier copy, by brute force over all pairs of positions."""
    seq = [(d, i, line) for d, t in docs for i, line in enumerate(x for x in t.split("\n") if WORD.search(x))]
    gone = set()
    for b in range(len(seq)):
        for a in range(b):
            n, words = 0, 0
            while b + n < len(seq) and seq[a + n][0] == seq[a][0] and seq[b + n][0] == seq[b][0] and seq[a + n][2] == seq[b + n][2]:
                words += len(WORD.findall(seq[b + n][2]))
                n += 1
            if words >= least:
                gone |= {seq[b + k][:2] for k in range(n)}
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["a b c", "d e", "f", "", "g h i j"]) for _ in range(rng.randint(0, 14)))) for i in range(12)]
    gone = _deleted(docs, 6)
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    for r in got:
        kept = [x for i, x in enumerate(x for x in dict(docs)[r.doc_id].split("\n") if WORD.search(x)) if (r.doc_id, i) not in gone]
        assert [x for x in r.text.split("\n") if WORD.search(x)] == kept
    assert gone


def test_line_dedup_behind_short_stretches(spark):
    """A repeated stretch too short for a run, then a line of its own, then a longer stretch: its first lines are no run by themselves."""
    docs = [(i, f"q r s\nown {i}\na b c\n{rest}") for i, rest in enumerate(["g h i", "d e f", "d e f\ng h i"])] + [(3, "d e f\ng h i\nq r s")]
    gone = _deleted(docs, 6)
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    assert {(r.doc_id, k) for r in got for run in r.deleted_runs for k in range(run.first, run.last + 1)} == gone == {(2, 2), (2, 3), (3, 0), (3, 1)}


def test_ids_are_sentencepieces_own(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    lanes = sentencepiece_codec.Lanes(v := sentencepiece_codec.Vocabulary.load())
    texts = ["".join(random.choice("ab  é日\n1.,_\t🙂xyzthein") for _ in range(random.randint(0, 90))) for _ in range(300)] + ["a" * 300, " " * 40 + "x", ""]
    flat, at = lanes.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == sp.encode(texts)
    search, out = sentencepiece_codec.Viterbi(v, lanes.trie), []
    for i in range(0, 60000, 100):
        out += search.feed("some more words " * 7 if i else " ")
    assert search.widest < 200 and out


def test_every_text_comes_back(spark, odd):
    rows = sentencepiece_codec.round_trip(odd).collect()
    assert all(r.exact for r in rows) and all((r.ids is None) == (r.text is None) for r in rows)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(odd.select("doc_id", "text")))
    assert all(r.decoded == r.text for r in both.collect())


def test_counts_of_the_quality_rules(spark):
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = r.text or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), failed)
        assert not (g.base_failed and g.kept)


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_near_classes_equal_brute_force(spark):
    got = {r.doc_id: r.class_id for r in QUERIES["op9_minhash_near_dedup"](spark, SF).collect()}
    sets = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = WORD.findall(r.text or "")
        sets[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both) and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if v == high else v for k, v in root.items()}
    assert got == root


def _near_brute_force(texts):
    """The smallest index of each text's class, over all pairs."""
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if v == high else v for v in root]
    return root


@pytest.mark.parametrize("ids", ["one", "null"])
def test_repeated_rows_lose_no_links(spark, ids):
    """Pairs of near copies in families of texts that are too different otherwise, each row several times; one row a
    band makes buckets of a whole family, so that pairs without a leader are left for the rare shingles."""
    rng, texts = random.Random(11), []
    for f in range(10):
        for m in range(12):
            own = [f"f{f}b{i}" for i in range(300)]
            for k in rng.sample(range(0, 300, 5), 3 if m < 2 else 8):
                own[k] = f"f{f}m{m}k{k}"
            texts.append(" ".join(own))
    want = Counter(_near_brute_force(texts))
    rows = [(i if ids == "one" else None, t) for i, t in enumerate(texts) for _ in range(3)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), rows=1).collect()
    assert max(want.values()) == 2
    if ids == "one":
        assert {r.doc_id: r.class_id for r in got} == dict(enumerate(_near_brute_force(texts)))
    assert sorted(r.class_size for r in got) == sorted(3 * n for n in want.values() for _ in range(3 * n))


def test_minhash_agreement_is_the_weighted_jaccard_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    item, wa, wb = rng.integers(0, 2**63, 40).astype(np.uint64), rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    values = near_dedup.signatures(np.repeat([0, 1], 40), np.concatenate([item, item]), np.concatenate([wa, wb]), 2, 3000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((values[0] == values[1]).mean() - want) < 0.04


def test_mix_meets_its_targets(spark, odd):
    for r in mixing.mix(odd).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.t - r.goal) < 1 and r.over <= 0


def test_pipeline_stages(spark, odd_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, SF).columns) == sorted(docs.columns), name
    rows = corpus_pipeline.run(spark, odd_dir).collect()
    assert rows and all(r.exact and r.n_ids for r in rows)
    assert queries.QUERIES
