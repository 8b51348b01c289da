"""The registered queries of the training-data operators and, where SQL can express them, their answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import (
    chat,
    decontamination,
    jaccard,
    lexical,
    line_spread,
    packing,
    periodic,
    sharding,
    substrings,
    toxicity,
    tree_bpe,
    voronoi,
)
from panelmill.llm.shipping import ship_package
from panelmill.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: documents with a number for each row, so that repeated ids stay apart
NUMBERED = "(SELECT row_number() OVER () AS rowid, doc_id, text, source FROM documents)"


def query(name: str, oracle: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_ftrl_toxicity")
def ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(documents, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query("op2_suffix_repeats")
def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query(
    "op4_line_spread",
    f"""
    WITH parts AS (
        SELECT rowid AS r, doc_id, text, source, string_split(text, chr(10)) AS parts FROM {NUMBERED}
    ), sets AS (
        SELECT list_sort(list_distinct([line FOR line IN parts IF line <> ''])) AS held, min(source) AS site FROM parts
        WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY held
    ), lines AS (
        SELECT r, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM parts
    ), spread AS (
        SELECT line FROM (SELECT site, unnest(held) AS line FROM sets) GROUP BY line HAVING count(DISTINCT site) >= 10
    ), judged AS (
        SELECT r, count(s.line) AS n, sum(length(l.line)) FILTER (WHERE s.line IS NOT NULL) AS lost, sum(length(l.line)) AS size,
            count(*) FILTER (WHERE l.line <> '') AS n_lines,
            string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE s.line IS NULL) AS kept
        FROM lines l LEFT JOIN spread s ON s.line = l.line GROUP BY r
    )
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN n > 0 AND lost < size THEN n ELSE 0 END AS n_removed,
        sha256(CASE WHEN n > 0 AND lost < size THEN coalesce(kept, '') ELSE coalesce(text, '') END) AS text_sha256
    FROM parts LEFT JOIN judged USING (r)
    """,
)
def line_spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the documents' sources; the rule is the pipeline's."""
    cleaned = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"), report=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


@query(
    "op5_voronoi_top_k",
    """
    WITH v AS (
        SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[]) AS BIGINT) AS score
        FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
    )
    SELECT query_id, rank, vec_id, score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    ) WHERE rank <= 5
    """,
)
def voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi.integer_vectors(table(spark, sf_dir, "embeddings"))
    return voronoi.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, repeats=True)


@query("op6_wu_manber_decontamination")
def wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # spans are start, end, start, end, ...: each end counts its words, each start takes away those before it
    signed = F.transform("spans", lambda bound, at: F.when(at % 2 == 1, bound).otherwise(-bound))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, bound: total + bound)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query("op7_grouped_prefix_join")
def grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op8_vector_sharding")
def vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.document_sizes(table(spark, sf_dir, "documents"))
    placed = sharding.shard_rows(
        sizes, key="doc_id", group=["text_hash", "text_crc32", "size"], dimensions={"size": 1024, "tokens": 1, "rows": 1}
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe conversation -1 speaks the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probes = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    template = chat.InstructionTemplate()
    return chat.read_back(chat.format_conversations(rows.unionByName(probes), template), template)


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(packing.tokenised_pieces(documents, tokenizer_file("word_bpe_49k.json")))


@query("op11_tree_bpe")
def tree_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = (tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = tree_bpe.encode_texts(table(spark, sf_dir, "documents"), *vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tree_bpe.decode_ids(encoded, *vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


WORDS = r"[^\x20\x09-\x0D]+"


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in ten is made periodic from some word on, as the query asks; a null doc_id leaves its text alone."""
    words = F.coalesce(F.regexp_extract_all(F.col("text"), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("original"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g, n = F.floor(F.col("h") / 10), F.size("original")
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    repeated = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get("original", F.when(i < start, i).otherwise(start + (i - start) % period))
    )
    folded = F.when((F.col("h") % 10 == 0) & (n > 0), repeated).otherwise(F.col("original"))
    found = periodic.periodic_runs(rows.select("doc_id", folded.alias("words")))
    best = F.aggregate(
        F.col("runs"),
        F.lit(None).cast(periodic.RUN_TYPE.elementType),
        lambda held, run: F.when(held.isNull() | (run["length"] * held["period"] > held["length"] * run["period"]), run).otherwise(held),
    )
    listed = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SQL_TERM = r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
SQL_TERMS = (
    f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_TERM}')"
)


@query(
    "op13_ball_tree_search",
    f"""
    WITH terms AS (SELECT row_number() OVER () AS r, doc_id, {SQL_TERMS} AS words FROM documents WHERE text IS NOT NULL),
    held AS (SELECT r, doc_id, words, len(words) AS n FROM terms WHERE len(words) > 0),
    corpus AS (SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS total FROM held),
    asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)),
    counted AS (
        SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM held)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), weighed AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * rows + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM counted, corpus GROUP BY term, rows
    ), scored AS (
        SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * rows) // total)))) AS BIGINT) AS score
        FROM asked JOIN counted USING (term) JOIN weighed USING (term), corpus GROUP BY item_id, r, doc_id
    )
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
        FROM scored WHERE score > 0
    ) WHERE rank <= 10
    """,
)
def ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
