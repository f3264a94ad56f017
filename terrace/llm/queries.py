"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import materialise, new_path, table
from .conversation_repair import damage, repair
from .exact_dedup import exact_dedup
from .language_id import identify
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_classes
from .quality_crf import classify
from .quality_rules import quality_rules
from .sentencepiece_codec import round_trip
from .sharding import shard
from .token_counts import BPE, WORDS, Rollup, change, count_tokens, revision, union
from .warc import archive_pages


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches: every row is inserted with its words and an estimate of its tokens,
    then the estimates are revised to the counts, then all rows of the first source, and those without a word, are deleted and
    inserted again. The second is replayed."""
    counts = materialise(count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("1-insert", union(change(counts, WORDS, "words"), change(counts, BPE, "estimate")))
    for _ in range(2):
        rollup.commit("2-revise", revision(counts, counts, BPE, "estimate", "tokens"))
    moved = counts.where((F.col("words") == 0) | F.col("source").eqNullSafe(F.lit(counts.agg(F.min("source")).first()[0])))
    rollup.commit("3-delete", union(change(moved, WORDS, "words", -1), change(moved, BPE, "tokens", -1)))
    rollup.commit("4-insert", union(change(moved, WORDS, "words"), change(moved, BPE, "tokens")))
    return rollup.totals()


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("deleted_lines").cast("long").alias("deleted_lines"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_ids", "exact")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)[0]


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_collocations": op13_collocations,
}

def _step(state: str, cost: str, letter: str, line: str | None, where: str = "TRUE") -> str:
    """SQL: the state after one edit, as its cost in eight digits with the audit (k) and the repaired text (t)."""
    text = f"({state}).t" if line is None else f"coalesce(({state}).t || chr(10), '') || {line}"
    return f"CASE WHEN ({state}) IS NOT NULL AND ({where}) THEN {{'k': lpad((({state}).k[1:8]::BIGINT + {cost})::VARCHAR, 8, '0') || ({state}).k[9:] || '{letter}', 't': {text}}} END"


def _best(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _repair_sql() -> str:
    """Dynamic programming over the turns, where the operator searches: states 0 nothing yet, 1 after system, 2 after user, 3 after assistant."""
    gone = lambda s: _step(s, "3", "D", None)
    kept = lambda s, role: _step(s, "late", "K", "line", f"ok AND role[1] = '{role}'")
    told = lambda s, role: _step(s, "late + 2", "R", f"'{role}:' || text", "ok")
    new = lambda s, role: _step(s, "2", "I", f"'{role}:'")
    none = "NULL::STRUCT(k VARCHAR, t VARCHAR)"
    crc = "list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"
    return rf"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        bad AS (SELECT *, xor({crc.format('name')}, 4294967295) % 20 AS fault FROM raw),
        dam AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM bad, (VALUES (0), (1)) AS copy(nth) WHERE fault <> 0 AND (nth = 0 OR fault = 3)),
        num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
        flt AS (
            SELECT *, nullif(right(regexp_replace(text, '[ 	-
]+$', ''), 1), '') AS last_char, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                   lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM num),
        t AS (SELECT *, last_char IS NULL AS blank, last_char IS NOT NULL AND again AS dup, last_char IS NOT NULL AND NOT again AND last_char NOT IN ('.', '!', '?') AS short FROM flt),
        c AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                   count(*) FILTER (short) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY 1),
        dp AS (
            SELECT conv_id, 0::BIGINT AS i, {{'k': '00000000', 't': NULL::VARCHAR}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM c
            UNION ALL
            SELECT conv_id, i, {gone('s0')}, {_best(gone('s1'), kept('s0', 's'))}, {_best(gone('o2'), *[f(x, r) for x in ('s0', 's1', 'o3') for f, r in ((kept, 'u'), (told, 'user'))])},
                   {_best(gone('o3'), kept('o2', 'a'), told('o2', 'assistant'))}
            FROM (SELECT *, {_best('s3', new('o2', 'assistant'))} AS o3
                  FROM (SELECT t.*, role || ':' || text AS line, short::INT AS late, NOT blank AND NOT dup AS ok, s0, s1, s3, {_best('s2', new('s0', 'user'), new('s1', 'user'), new('s3', 'user'))} AS o2
                        FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i + 1) x) y),
        fin AS (
            SELECT dp.conv_id, {_best('s0', 's3', new('s2', 'assistant'), new(new('s1', 'user'), 'assistant'))} AS e FROM dp JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(e.k[1:8]::BIGINT, 0) AS cost, coalesce(e.k[9:], '') AS audit, sha256(coalesce(e.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
    """


_REPAIR_SQL = _repair_sql()

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    # a line is deleted if it is in a shortest run of 50 words, from its first or its last line, that occurs earlier
    "op4_line_dedup": r"""
        WITH raw AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
        counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw),
        placed AS (SELECT *, sum((words > 0)::INT) OVER (PARTITION BY doc_id ORDER BY ln)::BIGINT AS unit FROM counted),
        seq AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY unit)::BIGINT AS till FROM placed WHERE words > 0),
        docs AS (SELECT doc_id, list(line ORDER BY unit) AS lines, max(till) AS total, max(unit) AS n FROM seq GROUP BY doc_id),
        spans AS (
            SELECT a.doc_id, a.unit AS first, min(b.unit) AS last FROM seq a JOIN seq b
                ON a.doc_id = b.doc_id AND b.unit >= a.unit AND b.till >= a.till - a.words + 50 GROUP BY ALL
            UNION
            SELECT b.doc_id, max(a.unit), b.unit FROM seq b JOIN seq a
                ON a.doc_id = b.doc_id AND a.unit <= b.unit AND a.till - a.words <= b.till - 50 GROUP BY b.doc_id, b.unit),
        runs AS (SELECT s.*, lines[first:last] AS body FROM spans s JOIN docs d ON s.doc_id = d.doc_id),
        copies AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM runs) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(first::BIGINT, last::BIGINT + 1)) AS unit FROM copies)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(g.n, 0)::BIGINT AS deleted_lines
        FROM documents d
        LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM placed p ANTI JOIN gone USING (doc_id, unit) GROUP BY doc_id) k ON d.doc_id = k.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
    """,
    "op6_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT *, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS lead FROM p)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN payload_bytes < 1000 OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> lead THEN lead END AS refers_to
        FROM g
    """,
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('mix-1|' || doc_id) AS mix_key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, cap / weight AS level, sum(source_size) OVER ()::DOUBLE AS total FROM w),
        r AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                     sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM l),
        t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN rest / open <= level THEN rest / open END) OVER (), level) * weight) AS target FROM r),
        x AS (SELECT d.*, t.source_size, t.target,
                     (sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start,
                     CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
        FROM x
    """,
    "op11_conversation_repair": _REPAIR_SQL,
    "op13_collocations": r"""
        WITH p AS (
            SELECT doc_id, row_number() OVER () AS nr, coalesce(lang, 'und') AS lang,
                   string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS pieces FROM documents),
        q AS (SELECT nr, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM p),
        v AS (SELECT nr, lang, k, regexp_extract_all(piece, '[^ 	]+') AS w FROM q),
        t AS (SELECT nr, lang, k, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM v),
        g AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY nr, k ORDER BY i)),
        f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
        f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY 1),
        c2 AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k, b.w1, b.w2 FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2 WHERE b.f >= 10),
        c3 AS (SELECT b.lang, b.w1 || ' ' || b.w2 || ' ' || b.w3 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f3 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f2 y ON y.lang = b.lang AND y.w1 = b.w2 AND y.w2 = b.w3
            UNION ALL SELECT b.lang, b.w1 || ' ' || b.w2 || ' ' || b.w3, b.f, x.f, y.f, 2 FROM f3 b JOIN f2 x ON x.lang = b.lang AND x.w1 = b.w1 AND x.w2 = b.w2 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w3),
        over2 AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        cuts AS (SELECT c2.lang, phrase, a, l, r, k FROM c2 LEFT JOIN over2 o ON o.lang = c2.lang AND o.w1 = c2.w1 AND o.w2 = c2.w2 WHERE o.f IS NULL OR 100 * o.f < 50 * a UNION ALL SELECT * FROM c3),
        s AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
        SELECT z.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
    """,
}
