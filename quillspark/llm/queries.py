"""The queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, knn, langid, ranked, transcripts
from .bpe import encode
from .fuzzy_lines import drop_fuzzy_lines
from .main_text import main_text
from .minhash import near_duplicates
from .mixing import mix
from .periodic import periodic_runs
from .substrings import drop_repeated_passages
from .url_lists import listed

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """The word vocabulary among the installed public files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    held_out = F.coalesce(held_out, F.lit(False))
    profiles = langid.learn(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "shards")


#: Dated block-list entries: kind, value, day, action.
URL_LIST = [
    ("domain", "spam-farm.example.org", "2024-01-10", "add"),
    ("domain", "spam-farm.example.org", "2024-05-01", "remove"),
    ("domain", "spam-farm.example.org", "2024-08-15", "add"),
    ("domain", "cheap-pills.example.com", "2024-02-01", "add"),
    ("domain", "example.net", "2024-11-01", "add"),
    ("domain", "example.net", "2024-11-20", "remove"),
    ("prefix", "www.cheap-pills.example.com/fr", "2024-01-01", "add"),
    ("prefix", "therha.example.com/en", "2024-03-01", "add"),
    ("prefix", "therha.example.com/en", "2024-03-01", "remove"),
    ("domain", "ththan.example.net", "2024-06-30", "remove"),
]


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time; here page k is of day k mod 366 of 2024."""
    pages = _table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    entries = spark.createDataFrame(URL_LIST, "kind string, value string, day string, action string")
    out = listed(pages.withColumn("fetched_at", day.cast("timestamp")), entries)
    return out.select("page_id", "url", F.to_date("fetched_at").alias("fetched_on"), "host", "blocked", "listed_key", "listed_since")


OP3_SQL = r"""
with entries(kind, value, day, action) as (values {values}),
days as (select kind || ':' || value as key, cast(day as date) as day, bool_or(action = 'add') as is_on from entries group by all),
changed as (select *, lag(is_on) over (partition by key order by day) as was from days),
turns as (select *, lead(day) over (partition by key order by day) as until from changed where is_on <> coalesce(was, false)),
spans as (select key, day as since, until from turns where is_on),
rows as (select page_id, url, cast(date '2024-01-01' + cast(page_id % 366 as integer) as date) as fetched_on,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') as host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda p: p <> '') as parts from pages),
hits as (select r.page_id, r.url, min(struct_pack(n := -length(s.key), key := s.key, since := s.since)) as hit from rows r join spans s
         on r.fetched_on >= s.since and (s.until is null or r.fetched_on < s.until)
         and (case when s.key like 'domain:%' then ends_with('.' || r.host, '.' || substr(s.key, 8))
              else starts_with(r.host || '/' || array_to_string(r.parts, '/') || '/', substr(s.key, 8) || '/') end) group by all)
select r.page_id, r.url, r.fetched_on, r.host, h.hit is not null as blocked, h.hit.key as listed_key, h.hit.since as listed_since
from rows r left join hits h on r.page_id is not distinct from h.page_id and r.url is not distinct from h.url
""".replace("{values}", ", ".join(map(str, URL_LIST)))


def op4_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5, scale=256)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(_table(spark, sf_dir, "documents"), vocabulary_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_fuzzy_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.search(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations with raw: the text as a transcript has it, under a speaker's name of the conversation's own style, which about one turn in five lacks."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names = {"user": ("User: ", "Human: ", "### Question: ", "**User:** "), "assistant": ("Assistant: ", "AI: ", "### Answer: ", "**Assistant:** "), "system": ("System: ", "Instructions: ", "### Context: ", "**System:** ")}
    marker = F.lit("")
    for role, forms in names.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, forms)), (style + 1).cast("int"))).otherwise(marker)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    return conversations.withColumn("raw", F.concat(F.when(bare, F.lit("")).otherwise(marker), F.coalesce("text", F.lit(""))))


def op10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learned from conversations of two folds in three and recovered for all of them."""
    raw = raw_transcripts(_table(spark, sf_dir, "conversations"))
    lines = transcripts.lines_of(raw, "conv_id", ["turn"], "raw", F.col("role"))
    held_out = F.crc32(F.col("conv_id").cast("binary")) % 3 == 1
    model = transcripts.learn(lines.filter(~held_out))
    parsed = transcripts.parse(lines, model)
    return parsed.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("place.row.k0").cast("long").alias("turn"), F.col("place.n").alias("line_no"), "role", "starts", "canonical")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=20)


OP11_SQL = r"""
with terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {term})) as term from documents),
counts as (select doc_id, term, count(*) as tf from terms group by all),
sizes as (select doc_id, count(*) as n from terms group by all),
whole as (select count(*) as n_all, cast(sum(n) as bigint) as terms_all from sizes),
lists as (select term, count(*) as df from counts group by all),
asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {term})) as term from benchmark),
weighed as (select item_id, term, count(*) * cast(floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)::double)) as bigint) as w from asked join lists using (term), whole group by item_id, term, df, n_all),
scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // terms_all)))) as bigint) as score from weighed join counts using (term) join sizes using (doc_id), whole group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0 qualify rank <= 20
""".replace("{term}", r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'")


def with_repeats(docs: DataFrame) -> DataFrame:
    """documents in which about one text in ten goes on periodically: with h = crc32(doc_id) divisible by 10 and g = h div 10, each word i >= a becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id or text stays as it is."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    again = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), a), period), F.lit(1), n), " ")
    chosen = F.coalesce((F.col("h") % 10 == 0) & (n > 0), F.lit(False))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    return split.select("doc_id", F.when(chosen, again).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")], F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_language, op2_mixing, op3_url_lists, op4_voronoi, op5_bpe, op6_minhash, op7_forest, op8_substrings, op9_lines, op10_transcripts, op11_ranked, op12_periodic, op13_main_text)
}

ORACLE_SQL: dict[str, str] = {"op3_url_lists": OP3_SQL, "op11_ranked": OP11_SQL}
