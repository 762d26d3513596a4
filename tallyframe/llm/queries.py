"""Registered queries of the operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.scratch import new_folder

from . import (
    exact_dedup, language_id, merkle, mixing, near_dedup, packing, sharding, simhash, spelling, token_counts, token_files,
    topk, url_filter,
)
from .rows import numbered

SEQUENCE_LENGTH, PACK_END = 2048, 0
FILE_END = 1
#: Small enough that small tables are split too, and the SQL checks more than one shard.
SHARD_BYTES = 256 << 10
BLOCK_ROWS = 32
#: Target weights of the mix, in parts; all other sources share one part.
SHARES = {"src0": 20, "src1": 10, "src2": 10, "src3": 8, "src4": 8, "src5": 6, "src6": 6, "src7": 5, "src8": 5,
          "src9": 4, "src10": 4, "src11": 3, "src12": 3, "src13": 2, "src14": 2, "src15": 1, "src16": 1, "src17": 1}
#: Of a run's crc32: a multiple of this loses a letter. Of an id's: a multiple of this is tampered with.
TYPO_EVERY, TAMPER_EVERY = 97, 7
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_LENGTH, PACK_END)
    digests = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, SEQUENCE_LENGTH)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), FILE_END)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(table(spark, sf_dir, "embeddings"), "row").select(
        "row", "vec_id", topk.whole_numbers(F.col("embedding")).alias("values")
    )
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20, row="row")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), SHARES, BLOCK_ROWS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    runs = spelling.words_in(docs)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    typed = F.when(h % TYPO_EVERY == 0, spelling.without_letter(F.col("run"), h % F.length("run"))).otherwise(F.col("run"))
    return spelling.spelling_forms(spelling.frequent_words(runs.select(typed.alias("word"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.crc32(doc_id.cast("string")) % TAMPER_EVERY == 0
    more = F.coalesce(F.try_add(n_chars, F.lit(1)), n_chars)
    claimed = F.when(tampered, merkle.leaf([doc_id, source, lang, more, text]))
    return merkle.manifest(docs, [doc_id, source, lang, n_chars, text], claimed=claimed)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_best_fit_packing, op3_url_filter, op4_token_files, op5_minhash_near_dedup,
              op6_exact_topk, op7_mixing, op8_language_id, op9_token_counts, op10_sharding, op11_spelling_variants,
              op12_merkle_manifest, op13_simhash_near_dedup)
}

_HASH = """cast('0x' || substr(md5(concat_ws(':', cast(doc_id as varchar), md5(coalesce(text, '')))), 1, 15) as bigint)"""
#: What a byte adds to a crc32, for all bytes.
_CRC_TABLE = """crc_table(t) as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)))"""
_SHARES = {mixing.REST: 1} | SHARES
_SHARE_ROWS = ", ".join(f"('{pool}', {share})" for pool, share in _SHARES.items())

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        with d as (
          select doc_id, length(coalesce(text, '')) as chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size,
               doc_id = first_value(doc_id) over w as kept, sha256(bare) as text_sha256
        from d window w as (partition by bare order by chars desc, doc_id)""",
    "op3_url_filter": r"""
        with cut as (
          select page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1) as h,
                 regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) as path from pages),
        p as (
          select page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from cut),
        rules(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fit as (
          select page_id, host, path, rh || rp as rule, v,
                 row_number() over (partition by page_id order by length(rh || rp) desc nulls last) as r
          from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fit where r = 1""",
    "op6_exact_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x
          from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
          select q.vec_id as query_id, c.vec_id, cast(list_inner_product(
                   cast(q.x as double[]), cast(c.x as double[])) as bigint) as score
          from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op7_mixing": f"""
        with recursive shares(pool, share) as (values {_SHARE_ROWS}),
        pools as (select list(pool order by pool) as names, list(share order by pool) as shares, sum(share) as period from shares),
        slots(t, done, pick) as (
          select cast(-1 as bigint), list_transform(shares, lambda w: cast(0 as bigint)), cast(null as bigint) from pools
          union all
          select t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + cast(i = best as int)), best
          from (select s.t, s.done, (list_min(list_filter(list_transform(range(1, len(s.done) + 1), lambda i: case
                  when s.done[i] * period // shares[i] <= s.t + 1
                  then [((s.done[i] + 1) * period + shares[i] - 1) // shares[i], i] end), lambda x: x is not null)))[2] as best
                from slots s, pools where s.t + 1 < period) n),
        turns as (
          select names[pick] as pool, t as slot, row_number() over (partition by pick order by t) - 1 as turn
          from slots, pools where pick is not null),
        d as (
          select doc_id, source, coalesce(pool, '{mixing.REST}') as pool, {_HASH} as h
          from documents left join shares on source = pool and pool <> '{mixing.REST}'),
        r as (select *, row_number() over (partition by pool order by h, doc_id) - 1 as rank from d),
        b as (
          select doc_id, source, r.pool, rank // {BLOCK_ROWS} as block, rank % {BLOCK_ROWS} as place, share, period
          from r join shares using (pool), pools),
        placed as (
          select b.*, block // share * period + slot as slot
          from b join turns on b.pool = turns.pool and block % share = turn),
        ends as (select pool, share, period, max(block) + 1 as next from b group by all),
        horizon as (select min(next // share * period + slot) as slot from ends e join turns on e.pool = turns.pool and next % share = turn)
        select doc_id, source, placed.pool, block, place, placed.slot, placed.slot < horizon.slot as in_mix from placed, horizon""",
    "op10_sharding": f"""
        with d as (
          select doc_id, octet_length(encode(coalesce(text, ''))) as bytes,
                 {_HASH} as h from documents),
        n as (
          select bits, h >> (60 - bits) as prefix, sum(bytes) as shard_bytes, count(*) as shard_rows
          from d, range(0, 61) t(bits) group by 1, 2
          having sum(bytes) <= {SHARD_BYTES} or min(h) = max(h) or bits = 60),
        b as (
          select d.*, n.*, row_number() over (partition by doc_id order by n.bits) as r
          from d join n on d.h >> (60 - n.bits) = n.prefix)
        select doc_id, bytes, case when bits = 0 then '' else right(lpad(bin(prefix), 64, '0'), cast(bits as int)) end as shard,
               shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} as over_limit from b where r = 1""",
    "op11_spelling_variants": f"""
        with recursive
        {_CRC_TABLE},
        runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents),
        counted as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all),
        bytes as (
          select run, n, list_concat([ascii(x) for x in string_split(id, '') if x <> ''], [58], flatten([case when unicode(x) < 128 then [unicode(x)]
                 else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end for x in string_split(run, '')])) as b from counted),
        hashed as (
          select run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[cast((xor(c, x) & 255) + 1 as int)])), 4294967295) as h
          from bytes, crc_table),
        typed as (
          select case when h % {TYPO_EVERY} = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word, n from hashed),
        words as materialized (select word, sum(n)::bigint as n from typed where length(word) >= 5 group by word having sum(n) >= 3),
        cut as (
          select word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) as rest
          from (select word, n, unnest(range(length(word))) as i from words) w),
        near as (
          select distinct a.word, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
          union select cut.word, words.word, words.n from cut join words on cut.rest = words.word
          union select words.word, cut.word, cut.n from cut join words on cut.rest = words.word),
        best as (
          select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word),
        forms as (
          select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n
          from words left join best using (word)),
        ways(word, last_word) as (
          select word, word from forms union all select ways.word, forms.form from ways join forms on ways.last_word = forms.word where forms.form is not null),
        roots as (select ways.word, last_word as root from ways join forms on ways.last_word = forms.word where forms.form is null)
        select word, form, root, n, n_near, form_n from forms join roots using (word)""",
    "op12_merkle_manifest": f"""
        with recursive
        {_CRC_TABLE},
        d as (
          select row_number() over () as r, doc_id, lang, n_chars,
                 list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x))),
                             lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 as int)])) as crc,
                 concat(coalesce(concat(octet_length(encode(cast(doc_id as varchar))), ':', doc_id), '-'),
                        coalesce(concat(octet_length(encode(source)), ':', source), '-'),
                        coalesce(concat(octet_length(encode(lang)), ':', lang), '-')) as head,
                 coalesce(concat(octet_length(encode(text)), ':', text), '-') as tail
          from documents, crc_table),
        leaves as (
          select r, doc_id, coalesce(lang, '') as lang, lang is not null as named,
                 sha256(concat(head, coalesce(concat(length(cast(n_chars as varchar)), ':', n_chars), '-'), tail)) as leaf,
                 case when xor(crc, 4294967295) % {TAMPER_EVERY} = 0 and n_chars is not null
                      then sha256(concat(head, length(cast(n_chars + 1 as varchar)), ':', n_chars + 1, tail)) end as claimed
          from d),
        placed as (
          select *, dense_rank() over (order by named, lang) - 1 as g,
                 row_number() over (partition by named, lang order by doc_id nulls first, leaf) - 1 as place from leaves),
        tree(g, level, place, digest, n) as (
          select g, 0, place, leaf, count(*) over (partition by g) from placed
          union all
          select g, level, place, digest, n from (
            select g, level + 1 as level, place // 2 as place, sha256(string_agg(digest, '' order by place)) as digest,
                   (any_value(n) + 1) // 2 as n
            from tree where n > 1 group by g, level, place // 2) up),
        top(level, place, digest, n) as (
          select 0, g, digest, count(*) over () from tree where n = 1
          union all
          select level, place, digest, n from (
            select level + 1 as level, place // 2 as place, sha256(string_agg(digest, '' order by place)) as digest, (any_value(n) + 1) // 2 as n
            from top where n > 1 group by level, place // 2) up),
        heights as (select g, max(level) as height, max(digest) filter (where n = 1) as subroot from tree group by g),
        steps as (
          select r, lv as level, s.place & 1 as is_right, beside.digest as sibling
          from (select r, g, lv, place >> cast(lv as int) as place from placed join heights using (g), range(0, 64) l(lv) where lv < height) s
          left join tree beside on beside.g = s.g and beside.level = s.lv and beside.place = xor(s.place, 1)
          union all
          select r, height + lv, s.place & 1, beside.digest
          from (select r, height, lv, g >> cast(lv as int) as place from placed join heights using (g), range(0, 64) l(lv)
                where lv < (select max(level) from top)) s
          left join top beside on beside.level = s.lv and beside.place = xor(s.place, 1)),
        folded(r, level, digest) as (
          select r, 0, coalesce(claimed, leaf) from placed
          union all
          select f.r, f.level + 1, sha256(case when is_right = 1 then concat(sibling, f.digest) else concat(f.digest, sibling) end)
          from folded f join steps s on s.r = f.r and s.level = f.level),
        proofs as (select r, sha256(string_agg(sibling, '' order by level)) as proof from steps where sibling is not null group by r),
        root as (select digest as root from top where n = 1),
        ends as (select r, max_by(digest, level) as folded_root from folded group by r)
        select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
        from placed join heights using (g) join ends using (r) left join proofs using (r), root""",
}
