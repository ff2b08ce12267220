"""Queries over sources, sequences, structures, quality, split, covariates and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import rounded, sql_round, table, with_views
from strandwise.functions import sequence as sq
from strandwise.operators import covariates, embedding, features, quality, sketches
from strandwise.operators.split import fold_of, split
from strandwise.session import ensure_checkpoint_dir
from strandwise.sources import tables

ASSAY_TARGETS = ("yield_value", "dsrna_percent", "expression", "not_measured")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources --------------------------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.write_csv(views.predictions(spark, sf), _folder(spark, "csv") + "/predictions.csv")
    return tables.read_table(spark, path).select(
        "seq_id",
        # An empty CSV field is read back as null.
        F.coalesce("sequence", F.lit("")).alias("sequence"),
        F.col("predicted_yield").cast("double").alias("predicted_yield"),
    )


def embedding_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "embeddings")
    path = tables.write_embeddings(source, _folder(spark, "embeddings") + "/table", "vec_id")
    stored = tables.read_embeddings(spark, path)
    cells = stored.select("vec_id", F.posexplode("embedding").alias("place", "value"))
    return rounded(cells.select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("value").cast("double").alias("value")))


def csv_lossless(spark: SparkSession, sf: str) -> DataFrame:
    """Text keys, missing words, texts among numbers and long whole numbers come back whole."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.concat(F.lit("O"), key).alias("seq_id"),
        F.when(key % 7 == 0, "NA").otherwise("ACGU").alias("sequence"),
        F.when(key % 11 == 0, "about 3").when(key % 5 == 0, "None").otherwise(F.col("o_custkey").cast("string")).alias("yield"),
        (F.lit("123456789012345678900").cast("decimal(38,0)") + F.col("o_custkey")).alias("big"),
    )
    path = tables.write_csv(raw, _folder(spark, "csv") + "/orders.csv")
    back = tables.load_sequences(spark, path, required=("sequence", "yield"), strict=False)
    return back.select(
        "seq_id", "sequence", "yield", F.col(tables.UNPARSED)["yield"].alias("lost"), F.col("big").cast("string").alias("big_text")
    )


# --- sequences and structures ---------------------------------------------------------


def sequence_classify(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq_id"), F.col("text").alias("raw"), views.sequence_of("text").alias("sequence")
    )
    marked = quality.classify_sequences(both).withColumnRenamed("status", "sequence_status")
    return marked.select(
        "seq_id", "strict_valid", "sequence_status", sq.classify("raw").alias("raw_status")
    )


def sequence_length_composition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.sequence_summary(views.sequences(spark, sf)))


def base_composition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.base_composition(views.sequences(spark, sf)))


def base_fractions(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.sequences(spark, sf).select(
        "seq_id",
        sq.sequence_length("sequence").alias("sequence_length"),
        sq.gc_content("sequence").alias("gc_content"),
        *[sq.base_fraction("sequence", b).alias(f"fraction_{b}") for b in sq.BASES],
    )
    return rounded(rows)


def structure_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        features.structure_features(views.sequences(spark, sf), views.structures(spark, sf))
    )


def alphabet_convert_truncate(spark: SparkSession, sf: str) -> DataFrame:
    keys = [m[0] for m in embedding.MODELS]
    chosen = views.sequences(spark, sf).withColumn(
        "model",
        F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("seq_id") % len(keys)).cast("int") + 1),
    )
    return embedding.model_input_per_row(chosen).select("seq_id", "model", "model_sequence")


def embedding_attach(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("seq_id"),
        F.col("embedding")[0].cast("double").alias("PC1"),
        F.col("embedding")[1].cast("double").alias("PC2"),
    )
    return rounded(features.attach(views.sequences(spark, sf), vectors))


def stack_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    parts = [e.where(F.col("label") < 5), e.where(F.col("label") >= 5), e.where(F.col("label").isNull())]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(
        stacked.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))
    )


def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = embedding.mean_pool(table(spark, sf, "embeddings"), ["label"])
    long = pooled.select("label", "n_tokens", F.posexplode("embedding").alias("position", "value"))
    return rounded(long)


# --- quality --------------------------------------------------------------------------


def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.missing_profile(views.assay(spark, sf)).drop("columns_with_missing"))


def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    profile = quality.missing_profile(views.assay(spark, sf))
    return profile.select(F.explode("columns_with_missing").alias("column", "missing_count"))


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_rows(table(spark, sf, "documents").drop("doc_id"))


def column_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").withColumn("batch", F.lit("one"))
    return quality.column_cardinality(documents)


def _profile_columns(df: DataFrame, *keys: str) -> DataFrame:
    names = PROFILE_COLUMNS
    return rounded(df.select(*keys, *names), 6, jarque_bera=3)


PROFILE_COLUMNS = [
    "missing_count", "missing_percentage", "mean", "std", "min", "max", "median", "q1", "q3",
    "lower_bound", "upper_bound", "outlier_count", "outlier_percentage", "min_outlier",
    "max_outlier", "skewness", "kurtosis", "jarque_bera", "normality_p",
]


def target_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = quality.target_profile(views.assay(spark, sf), ASSAY_TARGETS)
    return _profile_columns(profile, "target", "status")


def event_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile_columns(quality.profile(table(spark, sf, "events"), ["event_type"]), "event_type")


PROFILE_SQL = """
moments AS (
    SELECT k, count(*) AS n_rows, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std,
           min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median,
           quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
           kurtosis_pop(v) AS kurtosis
    FROM long GROUP BY k),
skew AS (
    SELECT k, avg(pow(v - mean, 3)) / pow(var_pop(v), 1.5) AS skewness
    FROM long JOIN moments USING (k) GROUP BY k),
bounds AS (
    SELECT *, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
    FROM moments JOIN skew USING (k)),
outs AS (
    SELECT k, count(*) AS outlier_count, min(v) AS min_outlier, max(v) AS max_outlier
    FROM long JOIN bounds USING (k) WHERE v < lower_bound OR v > upper_bound GROUP BY k),
facts AS (
    SELECT k, n_rows - n AS missing_count, (n_rows - n) * 100.0 / n_rows AS missing_percentage,
           mean, std, min, max, median, q1, q3, lower_bound, upper_bound,
           coalesce(outlier_count, 0) AS outlier_count,
           coalesce(outlier_count, 0) * 100.0 / n AS outlier_percentage, min_outlier, max_outlier,
           skewness, kurtosis, n / 6.0 * (pow(skewness, 2) + pow(kurtosis, 2) / 4) AS jarque_bera
    FROM bounds LEFT JOIN outs USING (k)),
profiled AS (SELECT *, exp(-jarque_bera / 2) AS normality_p FROM facts)
"""
_COUNTS = ("missing_count", "outlier_count")
PROFILE_SELECT = ", ".join(
    f"cast({c} AS bigint) AS {c}" if c in _COUNTS else sql_round(c, 6, jarque_bera=3)
    for c in PROFILE_COLUMNS
)
LONG_ASSAY = """
    SELECT 'yield_value' AS k, yield_value AS v FROM assay
    UNION ALL SELECT 'dsrna_percent', dsrna_percent FROM assay
    UNION ALL SELECT 'expression', expression FROM assay"""


def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.iqr_outliers(
        table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"]
    )
    return rounded(found.select("event_id", "event_type", "value", "lower_bound", "upper_bound"))


def price_outliers(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(quality.outlier_summary(lines, ["l_returnflag"], "l_extendedprice"))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def sketch_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate profile of two parts of a table, stored one after the other and merged: the
    exact facts, and whether every quartile's rank is within twice the bound."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", *LINE_COLUMNS)
    path, first = _folder(spark, "states"), F.col("l_returnflag").eqNullSafe("A")
    for part in (first, ~first):
        sketches.add_states(lines.where(part), LINE_COLUMNS, path, "l_returnflag")
    found = sketches.sketch_profile(sketches.read_states(spark, path))
    gaps = sketches.rank_gaps(lines, LINE_COLUMNS, found)
    near = (F.col("gap") <= 2 * sketches.rank_error(sketches.SIZE)).alias("within")
    return rounded(found.join(gaps, "column").select("column", "n_rows", "n", "missing_count", "least", "most", near))


def _dirty_assay(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.sequences(spark, sf).join(views.assay(spark, sf), "seq_id")
    return rows.withColumn(
        "dsrna_percent", F.when(F.col("enzyme_type") == "en", F.col("dsrna_percent"))
    )


DIRTY = """dirty AS (
    SELECT s.seq_id, sequence, yield_value,
           CASE WHEN enzyme_type = 'en' THEN dsrna_percent END AS dsrna_percent,
           expression, enzyme_type, temperature
    FROM sequences s JOIN assay a ON s.seq_id = a.seq_id)"""
DIRTY_FACTS = """facts0 AS (
    SELECT count(*) AS n, count(*) FILTER (WHERE sequence = '' OR sequence IS NULL) AS bad,
           (count(*) * 7 - count(seq_id) - count(sequence) - count(yield_value)
            - count(dsrna_percent) - count(expression) - count(enzyme_type) - count(temperature))
           * 100.0 / (count(*) * 7) AS gone
    FROM dirty)"""


def validation_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dirty_assay(spark, sf)
    profile = quality.target_profile(rows, ASSAY_TARGETS[:3])
    found = quality.recommendations(quality.validation_facts(rows), profile)
    return found.select("recommendation")


def critical_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.critical_issues(quality.validation_facts(_dirty_assay(spark, sf)))


# --- split, covariates, targets -------------------------------------------------------


def _parts(df: DataFrame, key: str) -> DataFrame:
    train, test = split(df.select(key), 0.2, 42, key)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


def seeded_split(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(table(spark, sf, "documents"), "doc_id")


def seeded_split_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(table(spark, sf, "orders"), "o_orderkey")


def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", fold_of("o_orderkey", 5).alias("fold"))


def _split_sql(name: str, key: str) -> str:
    return f"""
        SELECT {key}, CASE WHEN row_number() OVER (
                   ORDER BY md5(concat(cast({key} AS varchar), ':42')), {key})
               <= greatest(1, cast(floor((SELECT count(*) FROM {name}) * 0.2) AS bigint))
               THEN 'test' ELSE 'train' END AS part
        FROM {name}"""


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return covariates.column_types(customer, customer.columns)


def assay_column_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.assay(spark, sf)
    return covariates.column_types(rows, quality.covariate_columns(rows, ASSAY_TARGETS, ("seq_id",)))


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.assay(spark, sf)
    encoder = covariates.CovariateEncoder().fit(rows, ["enzyme_type", "temperature"])
    return encoder.transform(rows, ["seq_id"])


def scale_covariates(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    encoder = covariates.CovariateEncoder().fit(customer, ["c_mktsegment", "c_acctbal", "c_nationkey"])
    return rounded(encoder.transform(customer, ["c_custkey"]))


def target_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.assay(spark, sf)
    scaler = covariates.TargetScaler().fit(rows, ASSAY_TARGETS[:3])
    return rounded(scaler.transform(rows, ["seq_id"]))


def target_scale_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.assay(spark, sf)
    scaler = covariates.TargetScaler().fit(rows, ASSAY_TARGETS[:3])
    scaled = scaler.transform(rows, ["seq_id", "enzyme_type"])
    return rounded(scaler.inverse_transform(scaled))


SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, csv_lossless, embedding_round_trip, sequence_classify, sequence_length_composition,
        base_composition, base_fractions, structure_features, alphabet_convert_truncate,
        embedding_attach, stack_batches, mean_pool, missing_profile, missing_columns,
        duplicate_rows, column_cardinality, target_profile, event_profile, iqr_outliers,
        price_outliers, sketch_profile, validation_recommendations, critical_issues, seeded_split,
        seeded_split_orders, fold_assignment, column_types, assay_column_types, one_hot, scale_covariates,
        target_scale, target_scale_roundtrip,
    )
}


def _status_sql(column: str) -> str:
    # Spark, like Python, upper-cases one German letter to two.
    big = f"upper(replace({column}, 'ß', 'ss'))"
    return f"""CASE WHEN {column} IS NULL THEN 'null_sequence' WHEN {column} = '' THEN 'empty_sequence'
        WHEN regexp_full_match({big}, '[ACGU]+') THEN 'valid'
        ELSE concat('invalid_chars: {{''', array_to_string(list_sort(list_distinct(
             regexp_extract_all({big}, '[^ACGU]'))), ''', '''), '''}}') END"""


def _base_sql(base: str) -> str:
    return f"(length(sequence) - length(replace(sequence, '{base}', ''))) * 1.0 / nullif(length(sequence), 0)"


# Written out, so that a wrong entry in the registry shows.
_MODEL_ROWS = """(0, 'dnabert2', 2048, 'dna'), (1, 'dnabert2_large', 2048, 'dna'), (2, 'evo', 8192, 'rna'),
    (3, 'evo2_7b', 1048576, 'dna'), (4, 'evo2_40b', 1048576, 'dna'), (5, 'evo2_7b_base', 8192, 'dna'),
    (6, 'evo2_40b_base', 8192, 'dna'), (7, 'evo2_1b_base', 8192, 'dna')"""
_VALID = "regexp_full_match(upper(sequence), '[ACGU]+')"

ORACLE = {
    "csv_round_trip": with_views(
        "SELECT seq_id, sequence, predicted_yield FROM predictions", "predictions"
    ),
    "embedding_round_trip": """
        SELECT vec_id, place, round(cast(embedding[place + 1] AS double), 6) + 0.0 AS value
        FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS place FROM embeddings)""",
    "csv_lossless": """
        SELECT concat('O', o_orderkey) AS seq_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'ACGU' END AS sequence,
               CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE cast(o_custkey AS double) END AS yield,
               CASE WHEN o_orderkey % 11 = 0 THEN 'about 3' END AS lost,
               cast(123456789012345678900 + cast(o_custkey AS hugeint) AS varchar) AS big_text
        FROM orders""",
    "sequence_classify": with_views(
        f"""SELECT s.seq_id, coalesce(regexp_full_match(sequence, '[ACGU]+'), false) AS strict_valid,
               {_status_sql('sequence')} AS sequence_status, {_status_sql('text')} AS raw_status
        FROM sequences s JOIN documents d ON s.seq_id = d.doc_id""",
        "sequences",
    ),
    "sequence_length_composition": with_views(
        f"""WITH lengths AS (SELECT {_VALID} AS ok, CASE WHEN {_VALID} THEN length(sequence) END AS n
                             FROM sequences)
        SELECT count(*) AS total_sequences, count(*) FILTER (WHERE ok) AS valid_sequences,
               count(*) FILTER (WHERE NOT coalesce(ok, false)) AS invalid_sequences,
               round(avg(n), 6) + 0.0 AS mean_length, round(stddev_pop(n), 6) + 0.0 AS std_length,
               cast(min(n) AS bigint) AS min_length, cast(max(n) AS bigint) AS max_length,
               round(quantile_cont(n, 0.5), 6) + 0.0 AS median_length
        FROM lengths""",
        "sequences",
    ),
    "base_composition": with_views(
        "WITH fractions AS ("
        + " UNION ALL ".join(
            f"SELECT '{b}' AS base, {_base_sql(b)} AS f FROM sequences WHERE {_VALID}" for b in sq.BASES
        )
        + """) SELECT base, round(avg(f), 6) + 0.0 AS mean_fraction,
                      round(stddev_pop(f), 6) + 0.0 AS std_fraction FROM fractions GROUP BY base""",
        "sequences",
    ),
    "base_fractions": with_views(
        f"""SELECT seq_id, cast(length(sequence) AS bigint) AS sequence_length,
               round(coalesce({_base_sql('G')} + {_base_sql('C')}, 0.0), 6) + 0.0 AS gc_content,
               """
        + ", ".join(f"round({_base_sql(b)}, 6) + 0.0 AS fraction_{b}" for b in sq.BASES)
        + " FROM sequences",
        "sequences",
    ),
    "structure_features": with_views(
        r"""WITH counted AS (
            SELECT s.seq_id, length(s.sequence) AS n, mfe, dot_bracket AS d,
                   length(s.sequence) - length(replace(replace(s.sequence, 'G', ''), 'C', '')) AS gc,
                   t.seq_id IS NOT NULL AND length(s.sequence) > 0 AS ok
            FROM sequences s LEFT JOIN structures t ON s.seq_id = t.seq_id)
        SELECT seq_id,
               round(CASE WHEN ok THEN mfe ELSE 0 END, 6) + 0.0 AS mfe,
               round(CASE WHEN ok THEN mfe / n ELSE 0 END, 6) + 0.0 AS mfe_normalized,
               cast(CASE WHEN ok THEN len(regexp_extract_all(d, '\(\.{3,}\)')) ELSE 0 END AS bigint)
                   AS hairpin_count,
               cast(CASE WHEN ok THEN len(regexp_extract_all(d, '[()]+'))
                    - (CASE WHEN regexp_matches(d, '(^|\.)[()]$') THEN 1 ELSE 0 END)
                    ELSE 0 END AS bigint) AS stem_count,
               round(CASE WHEN ok THEN gc * 1.0 / n ELSE 0 END, 6) + 0.0 AS gc_content,
               cast(CASE WHEN ok THEN n ELSE 0 END AS bigint) AS sequence_length,
               cast(CASE WHEN ok THEN len(regexp_extract_all(
                        regexp_replace(d, '[()]+', '((', 'g'), '[()]\.{1,10}[()]'))
                    ELSE 0 END AS bigint) AS bulge_count,
               cast(CASE WHEN ok THEN len(regexp_extract_all(d, '\.+')) ELSE 0 END AS bigint)
                   AS loop_count,
               CASE WHEN n = 0 THEN 'empty_sequence' WHEN NOT ok THEN 'missing_structure'
                    ELSE 'ok' END AS fold_status
        FROM counted""",
        "structures",
    ),
    "alphabet_convert_truncate": with_views(
        f"""WITH models(i, model, max_length, kind) AS (VALUES {_MODEL_ROWS})
        SELECT seq_id, model, substring(CASE WHEN kind = 'dna' THEN translate(sequence, 'U', 'T')
               ELSE translate(sequence, 'T', 'U') END, 1, max_length) AS model_sequence
        FROM sequences JOIN models ON seq_id % 8 = i""",
        "sequences",
    ),
    "embedding_attach": with_views(
        """SELECT seq_id, sequence, round(cast(embedding[1] AS double), 6) + 0.0 AS "PC1",
               round(cast(embedding[2] AS double), 6) + 0.0 AS "PC2"
        FROM sequences JOIN embeddings ON seq_id = vec_id""",
        "sequences",
    ),
    "stack_batches": """
        SELECT vec_id, label, round(cast(embedding[1] AS double), 6) + 0.0 AS first FROM embeddings""",
    "mean_pool": """
        SELECT label, count(*) AS n_tokens, cast(p - 1 AS integer) AS position,
               round(avg(cast(x AS double)), 6) + 0.0 AS value
        FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS p, unnest(embedding) AS x
              FROM embeddings) u GROUP BY label, p""",
    "missing_profile": with_views(
        """SELECT count(*) AS n_rows,
               count(*) * 6 - count(seq_id) - count(yield_value) - count(dsrna_percent)
                   - count(expression) - count(enzyme_type) - count(temperature) AS total_missing_cells,
               round((count(*) - count(yield_value)) * 100.0 / (count(*) * 6), 6) + 0.0
                   AS missing_percentage,
               count(*) FILTER (WHERE yield_value IS NOT NULL AND dsrna_percent IS NOT NULL
                   AND expression IS NOT NULL AND enzyme_type IS NOT NULL) AS complete_rows
        FROM assay""",
        "assay",
    ),
    "missing_columns": with_views(
        """SELECT * FROM (
            SELECT 'yield_value' AS "column", count(*) - count(yield_value) AS missing_count FROM assay
            UNION ALL SELECT 'dsrna_percent', count(*) - count(dsrna_percent) FROM assay
            UNION ALL SELECT 'expression', count(*) - count(expression) FROM assay
            UNION ALL SELECT 'enzyme_type', count(*) - count(enzyme_type) FROM assay
            UNION ALL SELECT 'temperature', count(*) - count(temperature) FROM assay) m
        WHERE missing_count > 0""",
        "assay",
    ),
    "duplicate_rows": """
        SELECT cast(sum(n) AS bigint) AS n_rows, cast(sum(n - 1) AS bigint) AS duplicate_rows
        FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars) g""",
    "column_cardinality": """
        SELECT 'doc_id' AS "column", count(DISTINCT doc_id) <= 1 AS constant, false AS high_cardinality FROM documents
        UNION ALL SELECT 'text', count(DISTINCT text) <= 1, count(DISTINCT text) > count(*) * 0.5 FROM documents
        UNION ALL SELECT 'lang', count(DISTINCT lang) <= 1, count(DISTINCT lang) > count(*) * 0.5 FROM documents
        UNION ALL SELECT 'source', count(DISTINCT source) <= 1, count(DISTINCT source) > count(*) * 0.5 FROM documents
        UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) <= 1, false FROM documents
        UNION ALL SELECT 'batch', true, false""",
    "target_profile": with_views(
        f"""WITH long AS ({LONG_ASSAY}), {PROFILE_SQL}
        SELECT k AS target, 'present' AS status, {PROFILE_SELECT} FROM profiled
        UNION ALL SELECT 'not_measured', 'missing', {", ".join(["NULL"] * len(PROFILE_COLUMNS))}""",
        "assay",
    ),
    "event_profile": f"""
        WITH long AS (SELECT event_type AS k, value AS v FROM events), {PROFILE_SQL}
        SELECT k AS event_type, {PROFILE_SELECT} FROM profiled""",
    "iqr_outliers": f"""
        WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                   FROM events GROUP BY event_type),
        b AS (SELECT event_type, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
              FROM q)
        SELECT event_id, e.event_type, {sql_round('value, lower_bound, upper_bound')}
        FROM events e JOIN b ON e.event_type = b.event_type
        WHERE value < lower_bound OR value > upper_bound""",
    "sketch_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) AS n_rows, count({c}) AS n,
            count(*) - count({c}) AS missing_count, round(cast(min({c}) AS double), 6) + 0.0 AS least,
            round(cast(max({c}) AS double), 6) + 0.0 AS most, true AS within FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "price_outliers": f"""
        WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
                          quantile_cont(l_extendedprice, 0.5) AS median,
                          quantile_cont(l_extendedprice, 0.75) AS q3
                   FROM lineitem GROUP BY l_returnflag),
        b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q),
        o AS (SELECT l.l_returnflag, l_extendedprice AS x, b.*
              EXCLUDE (l_returnflag) FROM lineitem l JOIN b ON l.l_returnflag = b.l_returnflag),
        g AS (SELECT l_returnflag, first(q1) AS q1, first(median) AS median, first(q3) AS q3,
                     first(lower_bound) AS lower_bound, first(upper_bound) AS upper_bound,
                     count(*) FILTER (WHERE x < lower_bound OR x > upper_bound) AS outlier_count,
                     min(x) FILTER (WHERE x < lower_bound OR x > upper_bound) AS min_outlier,
                     max(x) FILTER (WHERE x < lower_bound OR x > upper_bound) AS max_outlier
              FROM o GROUP BY l_returnflag)
        SELECT l_returnflag, outlier_count,
               {sql_round('q1, median, q3, lower_bound, upper_bound, min_outlier, max_outlier')}
        FROM g""",
    "validation_recommendations": with_views(
        f"""WITH {DIRTY}, {DIRTY_FACTS},
        long AS ({LONG_ASSAY.replace('FROM assay', 'FROM dirty')}), {PROFILE_SQL}
        SELECT * FROM (
            SELECT CASE WHEN n < 1000 THEN format('{quality.ADVICE["small"].replace("%d", "{}")}', n) END
                   AS recommendation FROM facts0
            UNION ALL SELECT CASE WHEN bad > 0 THEN
                format('{quality.ADVICE["invalid"].replace("%d", "{}")}', bad) END FROM facts0
            UNION ALL SELECT CASE WHEN gone > 10 THEN
                format('{quality.ADVICE["missing"].replace("%.1f%%", "{:.1f}%")}', gone::double) END FROM facts0
            UNION ALL SELECT CASE WHEN missing_percentage > 20 THEN
                format('{quality.ADVICE["target_missing"].replace("%s", "{}").replace("%.1f%%", "{:.1f}%")}',
                       k, missing_percentage::double) END FROM profiled
            UNION ALL SELECT CASE WHEN outlier_percentage > 10 THEN
                format('{quality.ADVICE["outliers"].replace("%s", "{}").replace("%.1f%%", "{:.1f}%")}',
                       k, outlier_percentage::double) END FROM profiled) r
        WHERE recommendation IS NOT NULL""",
        "sequences", "assay",
    ),
    "critical_issues": with_views(
        f"""WITH {DIRTY}, {DIRTY_FACTS}
        SELECT * FROM (
            SELECT CASE WHEN bad > 0 THEN 'Invalid sequences found' END AS issue FROM facts0
            UNION ALL SELECT CASE WHEN gone > 50 THEN 'High missing data percentage' END FROM facts0) i
        WHERE issue IS NOT NULL""",
        "sequences", "assay",
    ),
    "seeded_split": _split_sql("documents", "doc_id"),
    "seeded_split_orders": _split_sql("orders", "o_orderkey"),
    "fold_assignment": """
        SELECT o_orderkey, cast(('0x' || substr(md5(concat(cast(o_orderkey AS varchar), ':42:fold')), 1, 8))::UBIGINT
               % 5 AS integer) AS fold
        FROM orders""",
    "column_types": """
        SELECT 'c_custkey' AS "column", CASE WHEN count(DISTINCT c_custkey) <= 10 THEN 'categorical' ELSE 'numeric' END AS kind FROM customer
        UNION ALL SELECT 'c_name', 'categorical'
        UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) <= 10 THEN 'categorical' ELSE 'numeric' END FROM customer
        UNION ALL SELECT 'c_acctbal', CASE WHEN count(DISTINCT c_acctbal) <= 10 THEN 'categorical' ELSE 'numeric' END FROM customer
        UNION ALL SELECT 'c_mktsegment', 'categorical'""",
    "assay_column_types": with_views(
        """SELECT 'enzyme_type' AS "column", 'categorical' AS kind
        UNION ALL SELECT 'temperature', CASE WHEN count(DISTINCT temperature) <= 10
            THEN 'categorical' ELSE 'numeric' END FROM assay""",
        "assay",
    ),
    "one_hot": with_views(
        "SELECT seq_id, "
        + ", ".join(
            f"CASE WHEN enzyme_type = '{v}' THEN 1.0::double ELSE 0.0::double END AS \"enzyme_type_{v}\""
            for v in ("en", "es", "fr")
        )
        + ", "
        + ", ".join(
            f"CASE WHEN temperature = {v} THEN 1.0::double ELSE 0.0::double END AS \"temperature_{v}\""
            for v in ("39.5", "42.0")
        )
        + " FROM assay",
        "assay",
    ),
    "scale_covariates": """
        WITH s AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1,
                          avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer)
        SELECT c_custkey, """
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{v}' THEN 1.0::double ELSE 0.0::double END AS \"c_mktsegment_{v}\""
        for v in SEGMENTS
    )
    + """, round((c_acctbal - m1) / s1, 6) + 0.0 AS c_acctbal,
               round((c_nationkey - m2) / s2, 6) + 0.0 AS c_nationkey
        FROM customer, s""",
    "target_scale": with_views(
        """WITH s AS (SELECT avg(yield_value) AS m1, stddev_pop(yield_value) AS s1,
               avg(dsrna_percent) AS m2, stddev_pop(dsrna_percent) AS s2,
               avg(expression) AS m3, stddev_pop(expression) AS s3 FROM assay)
        SELECT seq_id, round((yield_value - m1) / s1, 6) + 0.0 AS yield_value,
               round((dsrna_percent - m2) / s2, 6) + 0.0 AS dsrna_percent,
               round((expression - m3) / s3, 6) + 0.0 AS expression FROM assay, s""",
        "assay",
    ),
    "target_scale_roundtrip": with_views(
        f"""SELECT seq_id, enzyme_type, {sql_round('yield_value, dsrna_percent, expression')}
        FROM assay""",
        "assay",
    ),
}
