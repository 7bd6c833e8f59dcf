"""The operators applied to the whole tables, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chains, common, decontaminate, exact, language, minhash, quality, shard, suffix, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    dictionaries = language.fit(docs, ~held)
    out = language.classify(docs.select("doc_id", held.alias("held_out"), "text"), dictionaries, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.shard_by_bytes(common.table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(common.table(spark, sf_dir, "documents"))


def op5_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.fuzzy_passages(common.table(spark, sf_dir, "documents"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(common.table(spark, sf_dir, "documents")).drop("locator")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    grammar = toxicity.train(docs, common.table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs.withColumn("held_out", held), grammar, ["doc_id", "held_out"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.crc_mod(F.col("doc_id"), 3) == 1
    ranker = quality.train(docs, common.table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs.withColumn("held_out", held), ranker, ["doc_id", "held_out"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_language, op3_shards, op4_suffix, op5_chains, op6_exact, op7_bpe, op8_toxicity, op9_quality, op10_decontaminate)}


def _crc_table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1 for c in out]
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op1_minhash": f"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
        s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') x from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i from w where len(w) > 0)),
        n as (select doc_id, count(*) n from s group by 1),
        p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
        e as (select a, b from l union select b, a from l),
        r(doc_id, k) as (select a, a from e union select e.b, r.k from r join e on e.a = r.doc_id ),
        m as (select doc_id, min(k) k from r group by 1)
        select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.k, w.doc_id) component_id, coalesce(m.k, w.doc_id) = w.doc_id kept
        from w left join n on n.doc_id = w.doc_id left join m on m.doc_id = w.doc_id
    """,
    "op3_shards": f"""
        with tb as (select cast({_crc_table()} as bigint[]) t),
        y as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1 as bigint)) bytes from documents),
        crc as (select doc_id, xor(list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) text_crc32 from y, tb),
        s as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) size from documents),
        p as (select doc_id, size, cast(sum(size) over (order by doc_id) as bigint) upto, cast(sum(size) over () as bigint) al from s),
        q as (select *, cast(least(15, ((2 * upto - size) * 16) // (2 * al)) as integer) shard from p)
        select q.doc_id, size, text_crc32, 'bytes' law, shard, cast(row_number() over (partition by shard order by doc_id) - 1 as bigint) slot, cast(null as integer) grown_shard
        from q join crc using (doc_id)
    """,
    "op4_suffix": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
        k as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) m from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) i from d where len(h) >= 400)),
        r as (select m from k group by m having count(*) > 1),
        c as (select doc_id, i, lag(i) over (partition by doc_id order by i) p from k where m in (select m from r)),
        g as (select doc_id, i, sum(case when p is null or i - p > 200 then 1 else 0 end) over (partition by doc_id order by i) g from c),
        s as (select doc_id, min(i) a, max(i) + 200 b from g group by doc_id, g.g),
        e as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) z from s),
        n as (select e.doc_id, sum(b - a) removed, count(*) spans, max(b) z, string_agg(substr(h, 2 * e.z + 1, 2 * (a - e.z)), '' order by a) kept from e join d on d.doc_id = e.doc_id group by e.doc_id)
        select d.doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(removed, 0) as bigint) n_removed, coalesce(spans, 0) n_spans,
               sha256(unhex(case when n.doc_id is null then h else kept || substr(h, 2 * z + 1) end)) kept_sha256
        from d left join n on n.doc_id = d.doc_id
    """,
    "op6_exact": f"""
        with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) text_sha256 from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) keep_id, count(*) over (partition by text_sha256) group_size,
               doc_id = max(doc_id) over (partition by text_sha256) kept, text_sha256
        from t
    """,
    "op10_decontaminate": f"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
        bw as (select item_id, least(10, len(w)) n, unnest(range(1, greatest(2, len(w) - 8))) i, w from b where len(w) > 0),
        win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') x from bw),
        sizes as (select distinct n from win),
        dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) i, w from d, sizes where len(w) >= n),
        dx as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') x from dw),
        m as (select doc_id, i, dx.n, item_id from dx join win on dx.n = win.n and dx.x = win.x),
        hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from m) group by doc_id),
        its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from m group by doc_id)
        select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from d left join hit using (doc_id) left join its using (doc_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
