"""Inputs of the registered queries, derived from the given tables.

Every table below grows with them; each has a SQL twin of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import cte
from textlab.functions import hashing as H
from textlab.functions import names as N
from textlab.functions import text as T
from textlab.operators.explode import exploded
from textlab.operators.ranking import first_rows, positions
from textlab.operators.vectors import aggregate_both, vector_lookup
from textlab.session import scratch_path, written
from textlab.sources.readers import read_documents

# Invented lists for the synthetic prose of the test tables.
TERMS = ["and the", "and the by", "the by", "of the", "with"]
TRIGGERS = ["and the", "of the"]
REJECTS = ["and the by"]
CONDITIONS = ["with", "that"]
STOP_WORDS = "the of and to in a is that on it for as was be with by".split()
MEMBERS = [f"src{i}" for i in range(10)]
TOPIC_MEMBERS = ["src3"]
TOPIC_PATTERNS = ["with the by", "that is of"]
HORIZON_DAYS = 7
DIMS = 64

_written: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A written table, built once per application, like an input file."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        _written[key] = written(build(), name, keep=True)
    return _written[key]


def cached(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """As :func:`once`, for a table that ``build`` writes itself."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def full_documents(spark, sf):
    """Documents; a session may say how many partitions a scan of one small file should have."""
    partitions = spark.conf.get("spark.textlab.scan.partitions", None)
    return read_documents(spark, f"{sf}/documents.parquet", partitions and int(partitions))


def documents(spark, sf):
    return full_documents(spark, sf).select("doc_id", "text")


def posts(spark, sf):
    """Documents as posts with an author and a time; some authors are gone."""
    docs = full_documents(spark, sf)
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), "ts",
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("author"),
    )
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    title = F.substring_index("text", "\n", 1)
    return docs.join(events, "doc_id").join(labels, "doc_id", "left").select(
        "doc_id", "author", "ts", F.col("source").alias("community"), title.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"),
        "lang", "label",
    )


cte("posts", """
    SELECT d.doc_id, e.ts,
           CASE WHEN e.event_type <> 'error' THEN CAST(e.user_id AS VARCHAR) END AS author,
           d.source AS community, split_part(d.text, chr(10), 1) AS title,
           substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS body,
           d.lang, 1 - l.quality AS label
    FROM documents d JOIN events e ON d.doc_id = e.event_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")


def corpus(spark, sf):
    """Labelled documents; label 1 is the minority."""
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return documents(spark, sf).join(labels, "doc_id")


cte("corpus", """
    SELECT d.doc_id, d.text, 1 - l.quality AS label FROM documents d JOIN labels l USING (doc_id)""")


def history(spark, sf):
    """Posts with an author and a body."""
    return posts(spark, sf).where("author IS NOT NULL AND body <> ''")


cte("history", "SELECT * FROM posts WHERE author IS NOT NULL AND body <> ''", "posts")


def seen_authors(spark, sf):
    """Author keys that an earlier query visited."""
    events = table(spark, sf, "events").where("event_type = 'signup' AND value > 200")
    return events.select(H.hash_author(F.col("user_id").cast("string")).alias("author_key")).distinct()


cte("seen", """
    SELECT DISTINCT sha1(CAST(user_id AS VARCHAR)) AS author_key FROM events
    WHERE event_type = 'signup' AND value > 200""")


def existing_texts(spark, sf):
    return table(spark, sf, "documents").where("source = 'src15'").select("text")


cte("existing", "SELECT DISTINCT text FROM documents WHERE source = 'src15'")


def near_predicate(title="title", body="body"):
    text = T.post_text(F.col(title), F.col(body))
    return T.match_near(text, TRIGGERS, REJECTS, CONDITIONS)


# Positions (1-based) of the trigger phrases and their contexts, by cutting the
# text at the phrase and adding up lengths.
cte("near_text", """
    SELECT doc_id, lower(title) || ' ' || lower(body) AS t FROM posts""", "posts")
cte("near_parts", """
    SELECT n.doc_id, n.t, p.phrase, string_split(n.t, p.phrase) AS parts
    FROM near_text n, (VALUES ('and the'), ('of the')) p(phrase) WHERE contains(n.t, p.phrase)""",
    "near_text")
cte("near_at", """
    SELECT doc_id, t, phrase, unnest(list_transform(range(1, len(parts)), lambda k:
        1 + CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) AS BIGINT)
        + (k - 1) * length(phrase))) AS p
    FROM near_parts""", "near_parts")
cte("near_context", """
    SELECT doc_id, regexp_replace(substr(t, greatest(p - 80, 1), p + 80 - greatest(p - 80, 1)),
                                  '[^\\p{L}]', ' ', 'g') AS c
    FROM near_at WHERE NOT contains(t, 'and the by')""", "near_at")
cte("near", """
    SELECT DISTINCT doc_id FROM near_context WHERE contains(c, 'with') OR contains(c, 'that')""",
    "near_context")


def features(spark, sf):
    """Dense features: the embeddings, class 1 for label 0."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


cte("features", """
    SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vector,
           CAST(label = 0 AS INTEGER) AS label FROM embeddings""")


def word_ranks(spark, sf):
    """Words by the number of documents that hold them, numbered as embeddings are."""

    def build():
        distinct = F.array_distinct(T.letters_tokens(F.col("text")))
        words = exploded(documents(spark, sf), [], distinct, "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        ranked = positions(words, [F.desc("df"), "word"], "vec_id").select("word", "vec_id")
        return ranked.join(table(spark, sf, "embeddings").select("vec_id"), "vec_id").select("word", "vec_id")

    return once(spark, sf, "word_ranks", build)


def word_vectors(spark, sf):
    """The most frequent words, one per embedding."""

    def build():
        vectors = table(spark, sf, "embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        return word_ranks(spark, sf).join(vectors, "vec_id").select("word", "vector")

    return once(spark, sf, "word_vectors", build)


#: Sets of word vectors by their length.
SETS = (25, 50, 100, 200)


def sized_vectors(spark, sf, dims):
    """Word vectors of ``dims`` elements: a word's embedding and as much of those after it as it takes."""
    embeddings = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("part"))
    n = embeddings.count()
    pieces = -(-dims // DIMS)
    places = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    wanted = word_ranks(spark, sf).select("word", "vec_id", places).withColumn(
        "vec_id", F.pmod(F.col("vec_id") + F.col("piece"), F.lit(n)))
    parts = wanted.join(embeddings, "vec_id").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("p"))
    return parts.select("word", F.slice(F.flatten(F.transform("p", lambda x: x["part"])), 1, dims).alias("vector"))


def sized_lookup(spark, sf, dims):
    return once(spark, sf, f"lookup_{dims}", lambda: vector_lookup(
        written(sized_vectors(spark, sf, dims), "vectors"), lemmas(spark, sf)))


def sets_of_files(names):
    """``name, dims, how`` of those recorded files whose features can be built here."""
    known = {f"word_embeddings/word_embeddings_{d}_{'average' if h == 'mean' else 'sum'}.csv": (d, h)
             for d in SETS for h in ("mean", "sum")}
    return [(name, *known[name]) for name in sorted(names) if name in known]


def features_by_file(spark, sf):
    """The features of the labelled documents as recorded files have them, where these can be built, in a table with a folder for each."""

    def build():
        names = [r["filename"] for r in feature_sets(spark, sf).collect()]  # one for each file
        path = scratch_path(spark, "features", keep=True)
        files = sets_of_files(names)
        docs = corpus(spark, sf)
        for size in sorted({dims for _, dims, _ in files}):
            own = [(name, how) for name, dims, how in files if dims == size]
            sent = []
            both = aggregate_both(docs, sized_lookup(spark, sf, size), size, sent)
            each = F.explode(F.array(*[F.struct(F.lit(name).alias("filename"), F.col(how).alias("vector")) for name, how in own])).alias("f")
            rows = both.join(docs.select("doc_id", "label"), "doc_id").select(F.col("doc_id").alias("row_id"), "label", each)
            rows.select("row_id", "f.vector", "label", "f.filename").write.mode("append").partitionBy("filename").parquet(path)
            for one in sent:
                one.destroy()
        return spark.read.schema("row_id long, vector array<double>, label int, filename string").parquet(path)

    return cached(spark, sf, "features_by_file", build)


cte("letter_words", """
    SELECT doc_id, w AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
    FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
        SELECT doc_id, string_split(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ') AS ws
        FROM documents))
    WHERE w <> ''""")
cte("word_vectors", """
    SELECT r.word, CAST(e.embedding AS DOUBLE[]) AS vector FROM (
        SELECT word, row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, word) - 1 AS rank
        FROM letter_words GROUP BY word) r
    JOIN embeddings e ON e.vec_id = r.rank""", "letter_words")


def lemmas(spark, sf):
    """Words ending in ing, ed or s, and the words without that ending."""
    word = F.col("word")
    lemma = F.regexp_replace(word, "(ing|ed|s)$", "")
    return word_vectors(spark, sf).select("word", lemma.alias("lemma")).where(
        (F.col("lemma") != word) & (F.col("lemma") != "")
    )


cte("lemmas", """
    SELECT word, lemma FROM (SELECT word, regexp_replace(word, '(ing|ed|s)$', '') AS lemma FROM word_vectors)
    WHERE lemma <> word AND lemma <> ''""", "word_vectors")


def lookup(spark, sf):
    return once(spark, sf, "lookup", lambda: vector_lookup(word_vectors(spark, sf), lemmas(spark, sf)))


cte("lookup", """
    SELECT w.word, coalesce(l.lemma, w.word) AS lemma, v.vector
    FROM word_vectors w LEFT JOIN lemmas l ON l.word = w.word
    LEFT JOIN word_vectors v ON v.word = coalesce(l.lemma, w.word)""", "word_vectors", "lemmas")
cte("dims", "SELECT unnest(range(1, 65)) AS i")

# Masked text over whole documents. The word boundary of the SQL engine is
# ASCII, so every other letter (the tables hold no other non-ASCII characters)
# is wrapped into ASCII word characters first and unwrapped afterwards.
_MASK = (
    r"replace(replace(regexp_replace(regexp_replace({0}, '([^\x00-\x7F])', '_q9\1_q8', 'g'), "
    r"'\b(?:with|of the|the by|and the|and the by)\b', '', 'gi'), '_q9', ''), '_q8', '')"
)


def mask_sql(column: str) -> str:
    return _MASK.format(column)


cte("masked", f"SELECT doc_id, label, {mask_sql('text')} AS text FROM corpus", "corpus")


def results(spark, sf):
    """Recorded results: the first event of a feature file and classifier."""
    e, u = F.col("event_id"), F.col("user_id")
    encoder = F.get(F.array(*[F.lit(x) for x in N.ENCODERS]), (F.floor(u / 3) % 4).cast("int"))
    aggregation = F.when(e % 2 == 0, "sum").otherwise("average")
    name = F.when(u % 3 == 0, F.concat(F.lit("transformer/"), encoder, F.lit(".csv"))).otherwise(
        F.concat(F.lit("word_embeddings/"), N.feature_file_name((u + 1) * 25, aggregation)))
    forest, logistic, network = (e % 3 == i for i in range(3))
    columns = {
        "filename": name,
        "model": F.when(forest, "Random Forest").when(logistic, "Logistic Regression")
                 .otherwise("Neural Network"),
        "f1": 80 + (e * 7919 % 2000) / F.lit(100.0),
        "accuracy": 80 + (e * 104729 % 2000) / F.lit(100.0),
        "f1_variance": (e % 97) / F.lit(100000.0),
        "accuracy_variance": (e % 89) / F.lit(100000.0),
        "n_estimators": F.when(forest, (50 + e % 151).cast("int")),
        "max_features": F.when(forest, F.when(e % 4 < 2, "sqrt").otherwise("log2")),
        "criterion": F.when(forest, F.when(e % 8 < 4, "entropy").otherwise("gini")),
        "class_weight": F.when(~network & (e % 5 < 2), F.lit("balanced")),
        "c": F.when(logistic, (1 + e % 1000) / F.lit(10.0)),
        "penalty": F.when(logistic, F.when(e % 4 < 2, "l1").otherwise("l2")),
        "solver": F.when(logistic, F.when(e % 8 < 4, "liblinear").otherwise("saga")),
        "hidden_layer_sizes": F.when(network, F.when(
            e % 4 < 2, "(256, 128, 64, 32, 16)").otherwise("(256, 128, 64, 64, 32)")),
        "activation": F.when(network, F.when(e % 2 == 0, "relu").otherwise("tanh")),
        "batch_size": F.when(network, (64 * F.pow(2, e % 5)).cast("int")),
        "learning_rate": F.when(network, F.when(e % 4 < 2, "constant").otherwise("adaptive")),
        "learning_rate_init": F.when(network, (1 + e % 100) / F.lit(1000.0)),
    }
    rows = table(spark, sf, "events").select(
        e.alias("recorded"), *[c.alias(n) for n, c in columns.items()])
    return first_rows(rows, ["filename", "model"], ["recorded"], 1)


cte("results", """
    SELECT * FROM (
      SELECT event_id AS recorded,
        CASE WHEN user_id % 3 = 0 THEN 'transformer/' || (['transformer_all_minilm_l6_v2',
             'transformer_all_mpnet_base_v2', 'transformer_gtr_t5_base',
             'transformer_sentence_t5_base'])[1 + (user_id // 3) % 4] || '.csv'
             ELSE 'word_embeddings/word_embeddings_' || ((user_id + 1) * 25) || '_'
                  || CASE WHEN event_id % 2 = 0 THEN 'sum' ELSE 'average' END || '.csv' END AS filename,
        CASE event_id % 3 WHEN 0 THEN 'Random Forest' WHEN 1 THEN 'Logistic Regression'
             ELSE 'Neural Network' END AS model,
        80 + CAST(event_id * 7919 % 2000 AS DOUBLE) / 100 AS f1,
        80 + CAST(event_id * 104729 % 2000 AS DOUBLE) / 100 AS accuracy,
        CAST(event_id % 97 AS DOUBLE) / 100000 AS f1_variance,
        CAST(event_id % 89 AS DOUBLE) / 100000 AS accuracy_variance,
        CASE WHEN event_id % 3 = 0 THEN CAST(50 + event_id % 151 AS INTEGER) END AS n_estimators,
        CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 4 < 2 THEN 'sqrt' ELSE 'log2' END END AS max_features,
        CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 8 < 4 THEN 'entropy' ELSE 'gini' END END AS criterion,
        CASE WHEN event_id % 3 <> 2 AND event_id % 5 < 2 THEN 'balanced' END AS class_weight,
        CASE WHEN event_id % 3 = 1 THEN CAST(1 + event_id % 1000 AS DOUBLE) / 10 END AS c,
        CASE WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 4 < 2 THEN 'l1' ELSE 'l2' END END AS penalty,
        CASE WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 8 < 4 THEN 'liblinear' ELSE 'saga' END END AS solver,
        CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 4 < 2 THEN '(256, 128, 64, 32, 16)'
             ELSE '(256, 128, 64, 64, 32)' END END AS hidden_layer_sizes,
        CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'relu' ELSE 'tanh' END END AS activation,
        CASE WHEN event_id % 3 = 2 THEN CAST(64 * pow(2, event_id % 5) AS INTEGER) END AS batch_size,
        CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 4 < 2 THEN 'constant' ELSE 'adaptive' END END AS learning_rate,
        CASE WHEN event_id % 3 = 2 THEN CAST(1 + event_id % 100 AS DOUBLE) / 1000 END AS learning_rate_init
      FROM events)
    QUALIFY row_number() OVER (PARTITION BY filename, model ORDER BY recorded) = 1""")


def feature_sets(spark, sf):
    return results(spark, sf).select("filename").distinct()


cte("feature_sets", "SELECT DISTINCT filename FROM results", "results")

# The word vectors of the sets, by the embedding that a word's vector begins with.
cte("lemma_places", """
    SELECT l.word, l.lemma, r.rank FROM lookup l
    LEFT JOIN (SELECT word, row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, word) - 1 AS rank
               FROM letter_words GROUP BY word) r ON r.word = l.lemma AND l.vector IS NOT NULL""", "lookup", "letter_words")
cte("built_files", """
    SELECT filename, CAST(regexp_extract(filename, '_(\\d+)_', 1) AS INTEGER) AS dims, contains(filename, 'average') AS average
    FROM feature_sets WHERE regexp_matches(filename, '^word_embeddings/word_embeddings_(25|50|100|200)_(sum|average)\\.csv$')""",
    "feature_sets")
# The first and the last element of every file's features.
cte("file_edges", """
    SELECT f.filename, f.dims, d.doc_id, d.label, e.i,
           round(coalesce(sum(w.n * CAST(v.embedding[(e.i - 1) % 64 + 1] AS DOUBLE))
                          / CASE WHEN f.average THEN sum(w.n) ELSE 1 END, 0), 12) AS value
    FROM built_files f CROSS JOIN corpus d
    CROSS JOIN (SELECT unnest([1, 2]) AS side) s
    JOIN (SELECT unnest(range(1, 201)) AS i) e ON e.i = CASE WHEN s.side = 1 THEN 1 ELSE f.dims END
    LEFT JOIN (SELECT doc_id, k.rank, count(*) AS n FROM letter_words t JOIN lemma_places k ON k.word = t.word AND k.rank IS NOT NULL
               GROUP BY ALL) w ON w.doc_id = d.doc_id
    LEFT JOIN embeddings v ON v.vec_id = (w.rank + (e.i - 1) // 64) % (SELECT count(*) FROM embeddings)
    GROUP BY f.filename, f.dims, f.average, d.doc_id, d.label, e.i""", "built_files", "corpus", "letter_words", "lemma_places")
