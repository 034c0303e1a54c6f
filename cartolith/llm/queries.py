"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import chat, decontaminate, exact_dedup, language_id, merkle, packing, quality, secrets, simhash_dedup, sketch, spelling, toxicity, url_filter
from cartolith.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql
        return fn

    return register


@_query("op3_exact_dedup", """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS s FROM documents),
d AS (SELECT doc_id, length(t) AS p, sha256(s) AS text_sha256 FROM n),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY p DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def exact_dedup_query(table):
    """Copies of each document through the cuckoo-filter index."""
    return exact_dedup.exact_groups(table("documents"))


@_query("op7_secret_scan")
def secret_query(table):
    """Secrets in every document."""
    return secrets.secret_report(table("documents"))


@_query("op9_simhash_near_dedup")
def near_query(table):
    """Components of documents whose SimHash differs in two bits or fewer."""
    return simhash_dedup.near_groups(table("documents"))


@_query("op10_benchmark_decontamination")
def decontamination_query(table):
    """Benchmark windows in every document."""
    return decontaminate.contamination_report(table("documents"), table("benchmark")).drop("spans")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op5_best_fit_packing")
def packing_query(table):
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table("documents"), tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))


@_query("op1_language_id")
def language_query(table):
    """Language of every document."""
    return language_id.identify(table("documents"))


@_query("op4_toxicity")
def toxicity_query(table):
    """Toxicity of every document."""
    docs = table("documents")
    return toxicity.score(docs, toxicity.train(docs, table("labels")))


@_query("op8_quality")
def quality_query(table):
    """Quality of every document."""
    docs = table("documents")
    return quality.score(docs, quality.train(docs, table("labels")))


#: (verdict, host, path) of the rules of the URL query.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@_query("op2_url_filter")
def url_query(table):
    """Verdict on every page's URL."""
    return url_filter.judge(table("pages"), RULES)


@_query("op6_chat_format", """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, turn, md5(string_agg(concat(turn, chr(1), role, chr(2), text), chr(3)) OVER (PARTITION BY conv_id ORDER BY turn)) AS h,
             turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM t),
k AS (SELECT min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE last AND h NOT IN (SELECT h FROM p WHERE NOT last) GROUP BY h)
SELECT conv_id, turn, role, copies, concat('<|', role, '|>', chr(10), text, chr(10), '<|end|>', chr(10)) AS rendered FROM t JOIN k USING (conv_id)
""")
def chat_query(table):
    """Chat text of the conversations that no longer one begins with."""
    return chat.render(table("conversations"))


@_query("op11_merkle_manifest")
def manifest_query(table):
    """Leaf, subroot, root and proof of every document, and whether its tampered copy still verifies."""
    return merkle.manifest(table("documents"))


@_query("op12_document_fingerprints")
def fingerprint_query(table):
    """Sketches of every document and its edited copy, and their likeness to each other and to the next document."""
    return sketch.edit_report(table("documents"))


@_query("op13_spelling_variants")
def spelling_query(table):
    """Every word of the vocabulary with its near words, its form and the root of its forms."""
    return spelling.variants(table("documents"))
