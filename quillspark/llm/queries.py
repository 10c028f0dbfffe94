"""The op queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversation_repair, decontamination, fingerprint, hard_negatives, html_text, mixing, ngram_join, packing, quality_rules, secret_scan, sharding, substring_dedup, token_files
from .common import documents


def op7_quality_rules(spark, sf_dir):
    got = quality_rules.score(documents(spark, sf_dir, "doc_id", "text"))
    return got.drop("text")


def op1_fingerprints(spark, sf_dir):
    return fingerprint.edited_with_next(documents(spark, sf_dir, "doc_id", "text"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir, "doc_id", "source", "text"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir, "doc_id", "text"))


def op4_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secret_scan(spark, sf_dir):
    found = secret_scan.scan(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op6_source_mixing(spark, sf_dir):
    return mixing.takes(documents(spark, sf_dir, "doc_id", "source", "text"))


def op8_substring_dedup(spark, sf_dir):
    found = substring_dedup.repeats(documents(spark, sf_dir, "doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op9_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    put = sharding.shard(docs, "doc_id", 16)
    text = F.coalesce("text", F.lit(""))
    return put.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), 17).alias("grown_shard"),
    )


def op11_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.decontaminate(documents(spark, sf_dir, "doc_id", "text"), items)


def damaged(turns):
    """The conversations with turns dropped, emptied, cut, repeated or given to the user, by a hash of their place."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % 20
    t = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(damaged(turns)).withColumnRenamed("conv_id", "found")
    every = turns.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    whole = every.join(found, every["conv_id"].eqNullSafe(found["found"]), "left")
    return whole.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("label is not null and embedding is not null").where(whole).select("vec_id", scaled.alias("vector"), label.alias("label"))
    got = hard_negatives.mine(rows, anchors=F.col("vec_id") % 100 == 0)
    return got.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mixing": op6_source_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_sharding": op10_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op11_decontamination": op11_decontamination,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}
_WORD = r"[^\x20\x09-\x0D]+"

#: Exact components of the links, by the pairs that share a shingle; for tables of some thousand documents.
_OP3 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.b as component_id from documents d left join n using (doc_id) join (select a, min(b) as b from r group by 1) m on m.a = d.doc_id"""


def _op7() -> str:
    least = {
        "words": "n_words", "repeat_word_ratio": "n_repeat_words / n_words", "mean_word_length": "word_chars / n_words", "symbol_word_ratio": "n_symbols / n_words", "stop_words": "stops",
        "dup_line_ratio": "n_dup_lines / n_lines", "upper_ratio": "upper / word_chars", "bang_word_ratio": "bangs / n_words", "run_word_ratio": "runs / n_words",
    }
    rules = [f"coalesce({least[name]}, 0) {op} {bound}" for name, low, high in quality_rules.THRESHOLDS for op, bound in ((">=", low), ("<=", high)) if bound is not None]
    stops = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, count(*) over (partition by doc_id, g) as c from (select doc_id, i, array_to_string(w[i : i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8))),
v as (select doc_id, sum(least(8, coalesce(nx - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nx from g where c > 1) group by 1),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, cast(coalesce(v.n, 0) as bigint) as n_repeat_words, len(l) as n_lines,
  len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{stops}])) as stops, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as upper, len(list_filter(w, lambda x: x like '%!!')) as bangs, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as runs
  from d left join v using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(rules)} as kept from b"""


_OP11 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select distinct item, n, array_to_string(w[s : s + n - 1], ' ') as g from (select item, w, n, unnest(range(1, len(w) - n + 2)) as s from (select *, least(len(w), 10) as n from b where len(w) > 0))),
g as (select r, n, s, array_to_string(w[s : s + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from i))),
h as (select r, s, g.n, item from g join i on g.n = i.n and g.g = i.g),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from h) group by 1),
l as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct r, item from h) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(l.n_items, 0) as n_items, coalesce(l.sha, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (r) left join l using (r)"""



def _op12() -> str:
    """The least of 'cost audit' for each state and turn, backwards from the end."""
    add = lambda v, c, letter: f"printf('%08d', cast({v}[1:8] as integer) + {c}) || '{letter}' || {v}[9:]"
    to, keep = (2, 2, 3, 2), {0: "when initial = 'u' then {2} when initial = 's' then {1}", 1: "when initial = 'u' then {2}", 2: "when initial = 'a' then {3}", 3: "when initial = 'u' then {2}"}
    far = "'99999999'"
    after = lambda s: (
        f"least({add(f'v{s}', 4, 'D')}, case when fault in (1, 2) then {far} else {add(f'v{to[s]}', '3 + cut', 'R')} end, case when fault in (1, 2) then {far} {keep[s].format('', add('v1', 'cut', 'K'), add('v2', 'cut', 'K'), add('v3', 'cut', 'K'))} else {far} end)"
    )
    inserted = lambda s: f"least(x{s}, {add(f'x{to[s]}', 3, 'I')}, {add(f'x{to[to[s]]}', 6, 'II')})"
    return rf"""
with recursive t8 as (select n, n as v, 0 as k from range(256) t(n) union all select n, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from t8 where k < 8),
crc as (select list(v order by n) as tab from t8 where k = 8),
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)) as b from conversations),
k as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 as kind from c, crc),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from k where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
f as (select *, left(role, 1) as initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last, row_number() over (partition by conv_id, role, text order by i) as seen, lag(left(role, 1)) over (partition by conv_id order by i) as before, count(*) over (partition by conv_id) as n from o),
r as (select *, case when last = '' then 1 when seen > 1 then 2 when last not in ('.', '!', '?') then 3 else 0 end as fault from f),
w as (select conv_id, n + 1 as i, '00000000' as v0, '00000006II' as v1, '00000003I' as v2, '00000000' as v3 from (select distinct conv_id, n from r)
  union all select conv_id, i, {", ".join(f"{inserted(s)} as v{s}" for s in range(4))} from (select conv_id, i, {", ".join(f"{after(s)} as x{s}" for s in range(4))} from (select r.conv_id, r.i, r.initial, r.fault, case when r.fault = 3 then 3 else 0 end as cut, v0, v1, v2, v3 from w join r on r.conv_id is not distinct from w.conv_id and r.i = w.i - 1))),
a as (select conv_id, cast(v0[1:8] as bigint) as cost, v0[9:] as audit from w where i = 1),
l as (select conv_id, p, audit[p] as letter, len(replace(audit[1:p], 'I', '')) as i from (select *, unnest(range(1, len(audit) + 1)) as p from a)),
e as (select l.*, r.role, r.text, row_number() over (partition by l.conv_id order by p) as q, first_value(letter = 'K' and initial = 's') over (partition by l.conv_id order by p) as system from l left join r on r.conv_id is not distinct from l.conv_id and r.i = l.i where letter <> 'D'),
h as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (q - cast(system as integer)) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by p)) as sha from e group by 1),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from r group by 1)
select y.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) y left join g on g.conv_id is not distinct from y.conv_id left join a on a.conv_id is not distinct from y.conv_id left join h on h.conv_id is not distinct from y.conv_id"""


#: Every anchor with every row.
_OP13 = """
with e as (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor, a.r as ar, e.r, e.vec_id, a.label = e.label as same, cast(list_dot_product(cast(a.v as double[]), cast(e.v as double[])) as bigint) as score from e a join e on a.vec_id % 100 = 0 and a.r <> e.r),
p as (select *, row_number() over (partition by ar order by score desc, vec_id, r) as k from s where same qualify k <= 5),
n as (select p.anchor, p.vec_id as positive, p.score as positive_score, s.vec_id as negative, s.score as negative_score, row_number() over (partition by p.ar, p.r order by s.score desc, s.vec_id, s.r) as rank
  from p join s on s.ar = p.ar and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10)
select anchor as anchor_id, positive as positive_id, cast(rank as integer) as rank, negative as negative_id, positive_score, negative_score from n"""

#: The other operators rest on hashes, codes, models or byte runs that SQL can't follow; tests/llm has their plain versions.
ORACLE: dict[str, str] = {"op3_ngram_jaccard_join": _OP3, "op7_quality_rules": _op7(), "op11_decontamination": _OP11, "op12_conversation_repair": _op12(), "op13_hard_negatives": _OP13}
