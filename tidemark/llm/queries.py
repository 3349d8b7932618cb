"""The registered queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat,
    decontaminate,
    fill_middle,
    language,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    substrings,
    toxicity,
    urls,
)
from tidemark.llm.common import hex_digest
from workloads.base import Register, table

register = Register()

# The rules that the URL query applies, host, path and verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def fits_sql(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


URL_CASES = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))


@register.add(
    "op2_url_filter",
    f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), parts AS (
        SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
    ), shaped AS (
        SELECT page_id, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host,
               regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
        FROM parts
    ), ruled AS (
        SELECT page_id, host, path,
               CASE {' '.join(f"WHEN {fits_sql(h, p)} THEN '{h}{p}'" for h, p, _ in URL_CASES)} END AS rule
        FROM shaped
    )
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ({', '.join(f"'{h}{p}'" for h, p, v in URL_RULES if v == 'block')}) THEN 'block'
                ELSE 'allow' END AS verdict
    FROM ruled
    """,
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


@register.add("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def count(name: str):
        rank = [k.name for k in secrets.KINDS].index(name)
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{name}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k.name) for k in secrets.STRONG],
        hex_digest(secrets.spans_text(F.col("base"))).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register.add(
    "op4_quality_rules",
    f"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS body, {WORDS_SQL} AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
               len(string_split(coalesce(text, ''), chr(10))) AS n_lines
        FROM documents
    ), windows AS (
        SELECT doc_id, i, md5(array_to_string(words[i:i + 7], ' ')) AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)
    ), repeated AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
    ), covered AS (
        SELECT doc_id, sum(least(8, coalesce(after - i, 8)))::BIGINT AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM repeated)
        GROUP BY doc_id
    ), trigrams AS (
        SELECT doc_id, count(*) AS n, count(DISTINCT w) AS kinds
        FROM (SELECT doc_id, array_to_string(words[i:i + 2], ' ') AS w
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3))
        GROUP BY doc_id
    ), measured AS (
        SELECT s.doc_id, len(words)::BIGINT AS n_words,
               coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               coalesce(c.n, 0)::BIGINT AS n_repeat_words, n_lines,
               regexp_matches(body, '\\p{{L}}') AS has_letter, coalesce(4 * t.kinds < t.n, FALSE) AS few_trigrams
        FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id LEFT JOIN trigrams t ON s.doc_id = t.doc_id
    ), judged AS (
        SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM measured
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
                OR word_chars > 25 * n_words OR NOT has_letter OR few_trigrams) AS kept
    FROM judged
    """,
)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over measures that the result needs anyway, and a costly rule for what still stands.

    Costs are timed on a sample of measured rows, as the query meets them: a condition on a
    measure costs next to nothing there, the rule on runs of words reads the text again.
    """
    docs = table(spark, sf_dir, "documents")
    measured = quality.measure(docs)
    c = F.col
    conditions = {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 2 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "long_words": c("word_chars") > 25 * c("n_words"),
        "no_letters": ~c("has_letter"),
    }
    rules = [
        quality.Rule(r.name, lambda _, e=conditions[r.name]: e) if r.name in conditions else r for r in quality.RULES
    ]
    rules = quality.ordered_rules(docs, rules, "body", prepare=quality.measure)
    base = [r for r in rules if r.name in ("few_words", "repeated_windows")]
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.cascade(base, c("body")).isNotNull().alias("base_failed"),
        quality.cascade(rules, c("body")).isNull().alias("kept"),
    )


@register.add("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=64, distance=4)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@register.add(
    "op10_substring_dedup",
    f"""
    WITH split AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM split WHERE len(words) >= 35)
    ), repeated AS (
        SELECT doc_id, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
    ), places AS (SELECT doc_id, list(i) AS at FROM repeated GROUP BY doc_id),
    covered AS (
        SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM repeated)
    ), kept AS (
        SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.k) AS text, count(*) AS n
        FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split) w
        ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.k = c.k
        GROUP BY w.doc_id
    )
    SELECT s.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed,
           sha256(coalesce(k.text, '')) AS kept_sha256
    FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_passages(table(spark, sf_dir, "documents"), size=35, keep_text=False)
    return found.withColumnRenamed("id", "doc_id")


@register.add("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.fit_dictionaries(docs.filter(~language.held_out()))
    found = language.identify_language(docs, dictionaries).withColumnRenamed("id", "doc_id")
    return found.withColumn("held_out", language.held_out())


@register.add("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.filter(~toxicity.held_out())
    sample = toxicity.labelled_rows(docs, learned, "text", "doc_id", "toxic", fit_rows=30_000)
    found = toxicity.score_toxicity(docs, toxicity.fit(sample)).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )


@register.add("op8_mix_sources")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("copies")


@register.add("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_hits", "first_token", "last_token"
    )


@register.add(
    "op5_preferences",
    """
    WITH turns AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    ), lists AS (
        SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS all_turns
        FROM turns GROUP BY conv_id
    ), replied AS (
        SELECT conv_id, all_turns, list_filter(all_turns, lambda t: t.role = 'assistant') AS replies FROM lists
    ), chosen AS (
        SELECT conv_id, replies,
               list_filter(all_turns, lambda t: t.turn < replies[-1].turn OR t = replies[-1]) AS c
        FROM replied WHERE len(replies) > 0
    ), sides AS (
        SELECT conv_id, c, c[:-2] AS same, c[-1].text AS good,
               CASE WHEN len(replies) > 1 THEN replies[1].text WHEN len(c) > 1 THEN c[-2].text ELSE '' END AS bad
        FROM chosen
    ), cut AS (
        SELECT conv_id, good, bad, good = bad AS tie, CASE WHEN good = bad THEN c ELSE same END AS p FROM sides
    )
    SELECT conv_id, len(p)::INTEGER AS n_common,
           array_to_string(list_transform(
               p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
           CASE WHEN tie THEN '' ELSE '<|assistant|>' || chr(10) || good || '<|end|>' || chr(10) END AS chosen,
           CASE WHEN tie THEN '' ELSE '14:' || (14 + length(good) + 7)::VARCHAR END AS chosen_learned,
           CASE WHEN tie THEN '' ELSE '<|assistant|>' || chr(10) || bad || '<|end|>' || chr(10) END AS rejected,
           CASE WHEN tie THEN '' ELSE '14:' || (14 + length(bad) + 7)::VARCHAR END AS rejected_learned
    FROM cut
    """,
)
def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of every conversation against a copy that ends in a stale reply."""
    turns = chat.conversations(table(spark, sf_dir, "conversations"), "conv_id")
    return chat.format_preferences(*chat.stale_reply_pairs(turns)).withColumnRenamed("key", "conv_id")


HASH_SQL = "sha256('1:' || coalesce(doc_id::VARCHAR, ''))"


def draw_sql(i: int) -> str:
    return f"('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT AS h{i + 1}"


@register.add(
    "op11_fill_in_middle",
    f"""
    WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, {HASH_SQL} AS digest FROM documents),
    counted AS (SELECT doc_id, t, length(t) AS n, {', '.join(draw_sql(i) for i in range(4))} FROM drawn),
    cut AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM counted
    ), parts AS (
        SELECT doc_id, t, n, a, b, form, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut
    )
    SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars,
           CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        hex_digest(F.col("output")).alias("output_sha256"),
        hex_digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The table of CRC-32, one entry per byte, and the checksum of a hexadecimal text with it.
CRC_SQL = """
    crc AS (
        SELECT list(c ORDER BY b) AS bytes FROM (
            SELECT b, list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384)
                                                               ELSE x >> 1 END, b) AS c
            FROM (SELECT unnest(range(256)) AS b)
        )
    )"""


def crc_sql(text: str) -> str:
    pairs = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda p: ('0x' || p)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({pairs}, {step}, 4294967295), 4294967295)"


def shift_sql(turn: int, half: str) -> str:
    return f"('0x' || substr(md5('42:{turn}:' || {half}), 1, {sharding.DIGITS}))::BIGINT"


@register.add(
    "op12_shards",
    f"""
    WITH RECURSIVE {CRC_SQL}, sized AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
               row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, ''))) - 1 AS x
        FROM documents, crc
    ), sides AS (
        SELECT n, wide, (n + wide - 1) // wide AS high
        FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS wide FROM documents)
    ), round0 AS (
        SELECT x, x % wide AS l, x // wide AS r, n, wide, high
        FROM (SELECT *, unnest(range(wide * high)) AS x FROM sides)
    ), round1 AS (SELECT * REPLACE ((l + {shift_sql(0, 'r')}) % wide AS l) FROM round0
    ), round2 AS (SELECT * REPLACE ((r + {shift_sql(1, 'l')}) % high AS r) FROM round1
    ), round3 AS (SELECT * REPLACE ((l + {shift_sql(2, 'r')}) % wide AS l) FROM round2
    ), round4 AS (SELECT * REPLACE ((r + {shift_sql(3, 'l')}) % high AS r) FROM round3
    ), images AS (SELECT x, r * wide + l AS y, n FROM round4
    ), walks AS (
        SELECT x, y, n FROM images WHERE x < n
        UNION ALL
        SELECT w.x, i.y, w.n FROM walks w JOIN images i ON i.x = w.y WHERE w.y >= w.n
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, (y % 40)::INTEGER AS shard, y // 40 AS slot,
           NULL::INTEGER AS grown_shard
    FROM sized JOIN walks USING (x) WHERE y < n
    """,
)
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_sql(text: str) -> str:
    values = [f"{c}::VARCHAR" for c in LEAF_FIELDS[:-1]] + [text]
    packed = [f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values]
    return f"sha256({' || '.join(packed)})"


@register.add(
    "op13_merkle",
    f"""
    WITH RECURSIVE {CRC_SQL}, leaves AS (
        SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf_sql('text')} AS leaf,
               {leaf_sql(f"CASE WHEN {crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}
               AS tampered
        FROM documents, crc
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS i FROM leaves
    ), nodes AS (
        SELECT tree, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
        UNION ALL
        SELECT tree, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3
        FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3, n
    ), subroots AS (
        SELECT tree, digest AS subroot, level, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM nodes WHERE n = 1
    ), above AS (
        SELECT 0 AS level, i, subroot AS digest, count(*) OVER () AS n FROM subroots
        UNION ALL
        SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3
        FROM above WHERE n > 1 GROUP BY level, i // 3, n
    ), every AS (
        SELECT n.tree, n.level, n.i, n.digest, n.n FROM nodes n WHERE n.n > 1
        UNION ALL
        SELECT s.tree, s.level + a.level, a.i, a.digest, a.n FROM above a CROSS JOIN subroots s WHERE a.n > 1
    ), sides AS (
        SELECT a.tree, a.level, a.i,
               coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
               coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
        FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3
        GROUP BY a.tree, a.level, a.i
    ), tops AS (SELECT tree, level AS reach, i AS spot FROM subroots
    ), folds AS (
        SELECT p.doc_id, p.tree, p.i AS first, p.leaf, 0 AS level, CASE WHEN reach = 0 THEN spot ELSE p.i END AS i, '' AS proof,
               p.tampered AS cur, reach, spot
        FROM placed p JOIN tops USING (tree)
        UNION ALL
        SELECT f.doc_id, f.tree, f.first, f.leaf, f.level + 1,
               CASE WHEN f.level + 1 = reach THEN spot ELSE f.i // 3 END, f.proof || s.l || s.r,
               sha256(s.l || f.cur || s.r), reach, spot
        FROM folds f JOIN sides s ON s.tree = f.tree AND s.level = f.level AND s.i = f.i
    )
    SELECT f.doc_id, f.leaf, s.subroot, root.digest AS root, sha256(f.proof) AS proof_sha256,
           f.cur AS folded_root, f.cur = root.digest AS verified
    FROM folds f JOIN subroots s USING (tree) CROSS JOIN (SELECT digest, level FROM above WHERE n = 1) root
    WHERE f.level = f.reach + root.level
    """,
)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in LEAF_FIELDS]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaf = merkle.leaf_digest(columns)
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), merkle.leaf_digest([*columns[:-1], text]).alias("tampered"))
    found = merkle.build_manifest(leaves, "source", "doc_id", "leaf", ["tampered"])
    root = merkle.folded(F.col("tampered"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
