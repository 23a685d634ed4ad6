"""The registered query of each operator over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tristrata.llm import (
    credentials, decontaminate, exact_dedup, language, line_dedup, merkle, packing, sharding, simhash, spelling, substring_dedup, token_store,
    toxicity,
)
from tristrata.llm.registry import query, table
from tristrata.session import new_work_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_pack_cost_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), TOKENIZER, capacity=1024, end_id=0, with_ids=False).drop("ids")


@query()
def op2_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as read back from the shard files of a store of all documents, through its index."""
    docs, path = table(spark, folder, "documents"), new_work_path(spark, "token-store")
    token_store.write_store(docs, path, TOKENIZER, end_id=0)
    return token_store.read_documents(spark, path, docs.select("doc_id"), with_ids=False).drop("ids")


@query()
def op5_simhash_covering(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint of 4-word shingles and the component of fingerprints within 4 bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), radius=4, shingle=4)
    return found.select("doc_id", "fingerprint", "component_id")


@query(sql=r"""
with lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), grouped as (select t, max(doc_id) as keep_id, count(*) as group_size from lowered group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from lowered join grouped using (t)
""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the owner of its text."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep="largest")


@query()
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what is left of it without repeated passages of 20 words."""
    kept = substring_dedup.remove_repeated_passages(table(spark, folder, "documents"), window=20, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _secrets_sql(reach: int = 200) -> str:
    """Matches are marked and split as in any engine without positions of matches; parts meet by plain joins."""
    rules = {
        "assign": (credentials.ASSIGN, f"length(regexp_extract(m, '{credentials.ASSIGN.replace("'", "''")}', 2)) >= 6"),
        "access": (credentials.ACCESS, "length(m) >= 20"), "hex": (credentials.HEX, "length(m) >= 24"),
        "login": (credentials.LOGIN, f"length(regexp_extract(m, '{credentials.LOGIN.replace("'", "''")}', 2)) >= 3"),
        "key": (credentials.KEY, "length(m) = 40"), "endpoint": (credentials.ENDPOINT, "true"),
    }
    marked = " union all ".join(
        f"select doc_id, {i} as k, '{kind}' as kind, string_split(regexp_replace(text, '{pattern.replace("'", "''")}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) as p from t"
        for i, (kind, (pattern, _)) in enumerate(rules.items()))
    kept = " or ".join(f"kind = '{kind}' and {rule}" for kind, (_, rule) in rules.items())
    near = f"o.doc_id = s.doc_id and o.start - s.stop <= {reach} and s.start - o.stop <= {reach}"
    identifier = f"exists (select 1 from spans o where {near} and o.kind in ('access', 'login'))"
    secret = f"exists (select 1 from spans o where {near} and o.kind in ('assign', 'hex', 'key'))"
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k){}, '')"
    base = "filter (where kind in ('assign', 'access', 'hex'))"
    return f"""
with t as (select doc_id, translate(coalesce(text, ''), chr(1), chr(2)) as text from documents),
marked as ({marked}),
parts as (select doc_id, k, kind, unnest(p) as m, unnest(generate_series(1, len(p))) as i from marked where len(p) > 1),
placed as (select *, sum(length(m)) over (partition by doc_id, k order by i) as stop from parts),
spans as (select doc_id, k, kind, (stop - length(m))::bigint as start, stop::bigint as stop from placed where i % 2 = 0 and ({kept})),
reported as (select * from spans s where kind in ('assign', 'access', 'hex') or kind = 'key' and {identifier}
  or kind = 'login' and {secret} or kind = 'endpoint' and {identifier} and {secret})
select d.doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
  count(*) filter (where kind = 'hex') as n_hex, count(*) filter (where kind in ('login', 'key', 'endpoint')) as n_linked,
  sha256({joined.format(" " + base)}) as base_sha256, {joined.format("")} as spans
from documents d left join reported r on d.doc_id = r.doc_id group by d.doc_id"""


@query(sql=_secrets_sql())
def op10_multipart_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its secrets, and the weak parts that lie near their complements."""
    return credentials.scan_secrets(table(spark, folder, "documents"), reach=200)


SHARD_BYTES = 1 << 20


@query(sql=f"""
with sized as (
  select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h, octet_length(encode(coalesce(text, ''))) as b from documents
), buckets as (
  select depth, h >> (60 - depth) as prefix, sum(b)::bigint as shard_bytes, count(*) as shard_docs
  from sized, generate_series(0, 60) g(depth) group by all
), fitting as (
  select s.doc_id, s.b, min(depth) as depth from sized s join buckets k on k.prefix = s.h >> (60 - k.depth)
  where shard_bytes <= {SHARD_BYTES} or shard_docs = 1 group by s.doc_id, s.b
)
select f.doc_id, f.b as n_bytes, case when f.depth = 0 then '' else right(lpad(bin(k.prefix), 64, '0'), f.depth::int) end as shard,
  f.depth::int as depth, shard_docs, shard_bytes
from fitting f join sized s using (doc_id) join buckets k on k.depth = f.depth and k.prefix = s.h >> (60 - f.depth)
""")
def op3_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its shard of at most a mebibyte of text."""
    return sharding.assign_shards(table(spark, folder, "documents"), SHARD_BYTES).drop("page")


def _remainder(n: int):
    """CRC-32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query()
def op6_toxicity_compression(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score, learned from the labels of documents whose remainder by three is not one."""
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), learn=_remainder(3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op4_language_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its language, learned from documents whose remainder by four is not two."""
    docs = table(spark, folder, "documents")
    model = language.train(docs, learn=_remainder(4) != 2)
    return language.identify(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op7_decontaminate_qgrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in which a benchmark item occurs with edits of up to a tenth of its length, and the item."""
    return decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(sql=r"""
with t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from t),
shared as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(s.k) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where s.k is null), '')) as kept_sha256
from keyed left join shared s using (k) group by doc_id
""")
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what is left of it without the lines that ten documents share."""
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents"), min_documents=10, min_chars=1, with_text=False)
    return kept.drop("kept_text")


#: The table of CRC-32 by bytes, as a list ``t``.
_CRC_STEPS = """bits(x, k, v) as (select range::bigint, 0, range::bigint from range(256)
  union all select x, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
steps as (select list(v order by x) as t from bits where k = 8)"""


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, beside ``steps``."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda c: ('0x' || c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def _manifest_sql(levels: int = 8, top: int = 4) -> str:
    """The tree level by level, for groups of up to ``8 ** levels`` rows and up to ``8 ** top`` groups."""
    def digests(text: str) -> str:
        fields = [f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
        return f"sha256({' || '.join([*fields, f"coalesce(strlen({text}) || ':' || {text}, '-')"])})"

    def grown(name: str, by: str, count: int) -> str:
        hashed = "case when any_value(total) = 1 then any_value(d) else sha256(string_agg(d, '' order by i)) end as d, (any_value(total) + 7) // 8 as total"
        return ",\n".join(f"{name}{k + 1} as (select {by}, i // 8 as i, {hashed} from {name}{k} group by {by}, i // 8)" for k in range(count))

    def folded(name: str, nodes: str, by: str, count: int) -> str:
        parts = []
        for k in range(count):
            step = "any_value(r.f) else sha256(string_agg(case when n.i = r.i then r.f else n.d end, '' order by n.i)) end as f"
            proof = "any_value(r.proof) || coalesce(string_agg(n.d, '' order by n.i) filter (n.i <> r.i), '') as proof"
            parts.append(f"{name}{k + 1} as (select r, any_value(r.{by}) as {by}, any_value(r.i) // 8 as i, case when any_value(n.total) = 1 then {step}, {proof} "
                         f"from {name}{k} r join {nodes}{k} n on n.{by} is not distinct from r.{by} and n.i // 8 = r.i // 8 group by r)")
        return ",\n".join(parts)

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive {_CRC_STEPS},
crc as (select doc_id, {_crc("doc_id::varchar")} as h from documents, steps),
leaves as (select d.doc_id, lang, {digests("text")} as leaf, case when h % 3 = 0 then {digests(lower)} end as claim from documents d left join crc using (doc_id)),
placed as (select *, row_number() over () as r, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as total from leaves),
n0 as (select lang, i, leaf as d, total from placed),
{grown("n", "lang", levels)},
m0 as (select 1 as one, lang, row_number() over (order by lang nulls first) - 1 as i, d, count(*) over () as total from n{levels}),
{grown("m", "one", top)},
f0 as (select r, lang, i, coalesce(claim, leaf) as f, '' as proof from placed),
{folded("f", "n", "lang", levels)},
g0 as (select r, 1 as one, m0.i, f, proof from f{levels} f join m0 on m0.lang is not distinct from f.lang),
{folded("g", "m", "one", top)}
select doc_id, leaf, m0.d as subroot, m{top}.d as root, sha256(proof) as proof_sha256, f as folded_root, f = m{top}.d as verified
from placed p join g{top} g on g.r = p.r join m0 on m0.lang is not distinct from p.lang, m{top}"""


@query(sql=_manifest_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its proof, verified against rows of which some have their text lower-cased."""
    docs, path = table(spark, folder, "documents"), new_work_path(spark, "manifest")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(_remainder(3) == 0, merkle.row_digest(["doc_id", "source", "lang", "n_chars", lowered]))
    manifest = merkle.write_manifest(docs, path, ("doc_id", "source", "lang", "n_chars", "text"), group="lang", key="doc_id", claim=tampered)
    return manifest.prove().select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(sql=rf"""
with recursive {_CRC_STEPS},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) as w from documents),
counted as (select doc_id, w, count(*) as c from runs where length(w) >= 7 group by doc_id, w),
summed as (select w, c, {_crc("coalesce(doc_id::varchar, '') || ':' || w")} as h from counted, steps),
slipped as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, c from summed),
words as (select word, sum(c)::bigint as n from slipped where length(word) >= 7 group by word having sum(c) >= 2),
without as (select word, n, p, substr(word, 1, p::int - 1) as a, substr(word, p::int + 1) as b from words, generate_series(1, length(word)) g(p)),
near as (
  select x.word, y.word as other, y.n as m from without x join without y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from without x join words y on y.word = x.a || x.b
  union select y.word, x.word, x.n from without x join words y on y.word = x.a || x.b),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= 10 * w.n then (select min(other) from near where near.word = w.word and near.m = b.m) end as form,
  case when b.m >= 10 * w.n then b.m end as form_n from words w left join best b using (word)),
chains(word, last, steps) as (select word, form, 1 from formed where form is not null
  union all select c.word, f.form, c.steps + 1 from chains c join formed f on f.word = c.last where f.form is not null)
select word, form, coalesce((select arg_max(last, steps) from chains where chains.word = f.word), word) as root, n, n_near, form_n from formed f
""")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of all documents with its most frequent spelling; one occurrence in 31 has lost a letter."""
    return spelling.spelling_variants(table(spark, folder, "documents"), min_chars=7, min_count=2, ratio=10, slip=31)
