"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import (
    chaining, codes, language, licenses, mixing, negatives, phrases, pieces, resampling, rules, simhash, toxicity, winnowing,
)
from metricloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            STATEMENTS[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_definition() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as held:
        return held.read()


def piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as held:
        return held.read()


# words, windows and their occurrences with lists; only SQL's own functions
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP1 = rf"""
with d as (select doc_id, text, row_number() over () as r from documents),
dw as (select doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from d),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from benchmark),
iwin as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
         from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct n from iwin),
dwin as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as win
         from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hits as (select r, i, dwin.n as n, item_id from dwin join iwin on dwin.n = iwin.n and dwin.win = iwin.win),
hitwords as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
hititems as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as names from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hitwords using (r) left join hititems using (r)
"""


@query(OP1)
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(table(spark, folder, "documents")).select(
        "doc_id", "license", "containment", "first_word", "n_windows")


@query()
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.passages(table(spark, folder, "documents"))


OP4 = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                  md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, sum(source_size) over () as total from s),
l as (select *, (1.5::double * total - 2::double * coalesce(sum(source_size) over (order by source_size / weight::double, source nulls last rows between unbounded preceding and 1 preceding), 0))
             / (sum(weight) over (order by source_size / weight::double, source nulls last rows between current row and unbounded following))::double as level from w),
m as (select *, max(case when level * weight < 2::double * source_size then level end) over () as water from l),
t as (select source, source_size, case when level * weight < 2::double * source_size then water * weight else 2::double * source_size end as target from m),
q as (select *, cast(floor(target + 0.5) as bigint) as quota from t),
b as (select d.*, q.source_size, q.target, q.quota, quota // greatest(source_size, 1) as passes,
             coalesce(sum(size) over (partition by d.source order by k, size, doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target,
       cast(case when size > 0 then passes * size + greatest(0, least(size, quota - passes * source_size - before)) else 0 end as bigint) as taken
from b
"""


@query(OP4)
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP5 = r"""
with d as (select doc_id, lang, source, row_number() over () as r, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, array_to_string(w[i:i + 4], ' ') as win from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
twice as (select r, i from win join (select r, win from win group by r, win having count(*) > 1) using (r, win)),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
m as (select r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
             cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
      from w left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
v as (select r, doc_id, lang, source, base_failed, unnest([
        {'m': 'word_length', 'v': 1000 * word_chars // greatest(n_words, 1)}, {'m': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1)},
        {'m': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1)}, {'m': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1)}]) as x from b),
bins as (select lang, source, x.m as m, (x.v >> greatest(length(bin(x.v)) - 7, 0)) << greatest(length(bin(x.v)) - 7, 0) as bin, count(*) as n
         from v where not base_failed group by all),
of_all as (select m, bin, cast(sum(n) as hugeint) as n_all from bins group by m, bin),
of_lang as (select lang, m, bin, cast(sum(n) as hugeint) as n_lang from bins group by lang, m, bin),
grid as (select g.lang, g.source, a.m, a.bin, n_all, coalesce(n_lang, 0) as n_lang, cast(coalesce(o.n, 0) as hugeint) as n_own
         from (select distinct lang, source from bins) g cross join of_all a
         left join of_lang l on l.lang is not distinct from g.lang and l.m = a.m and l.bin = a.bin
         left join bins o on o.lang is not distinct from g.lang and o.source is not distinct from g.source and o.m = a.m and o.bin = a.bin),
summed as (select *, sum(n_all) over g as t_all, sum(n_lang) over g as t_lang from grid window g as (partition by lang, source, m)),
weighed as (select lang, source, m, bin, n_own * (t_all * (t_lang + 20)) + 20 * (n_lang * t_all + 20 * n_all) as w from summed),
upto as (select *, sum(w) over (partition by lang, source, m order by bin) as upto, sum(w) over (partition by lang, source, m) as total from weighed),
q as (select lang, source, m, min(case when 10 * upto >= total then bin end) as q10, min(case when 10 * upto >= 5 * total then bin end) as q50,
             min(case when 10 * upto >= 9 * total then bin end) as q90 from upto group by lang, source, m),
x as (select u.lang, u.source, u.m, q10, q50, q90, cast(10 * sum(greatest(bin - q90, 0) * w) // max(total) as bigint) as excess
      from upto u join q on q.lang is not distinct from u.lang and q.source is not distinct from u.source and q.m = u.m group by all),
f as (select *, q90 + greatest(2 * (q90 - q50), excess * case m when 'word_length' then 0 when 'symbols' then 1 else 5 end) as high,
             case when m = 'word_length' then q10 - 2 * (q50 - q10) end as low from x),
bad as (select distinct v.r from v join f on v.lang is not distinct from f.lang and v.source is not distinct from f.source and v.x.m = f.m
        where v.x.v > f.high or v.x.v < f.low)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and r not in (select r from bad) as kept from b
"""


@query(OP5)
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op6_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-codes")
    codes.write_tokens(table(spark, folder, "documents"), path, tokenizer_definition())
    return codes.read_documents(spark, path)


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.predictions(table(spark, folder, "documents"))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op9_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


OP11 = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
g as (select lang, k, w[i:i + k - 1] as ws from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)),
f as (select lang, k, array_to_string(ws, ' ') as phrase, any_value(ws) as ws, count(*) as a from g group by lang, k, array_to_string(ws, ' ')),
totals as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
cand as (select * from f where k >= 2 and a >= 30),
cuts as (select lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') as left_part, array_to_string(ws[j + 1:k], ' ') as right_part
         from (select *, unnest(range(1, k)) as j from cand)),
scores as (select c.lang, c.phrase, c.k, c.a, c.j, l.a as l, r.a as r, cast((2000000::hugeint * c.a) // (l.a + r.a) as bigint) as score
           from cuts c join f l on l.lang = c.lang and l.phrase = c.left_part and l.k = c.j
                join f r on r.lang = c.lang and r.phrase = c.right_part and r.k = c.k - c.j),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from scores) where o = 1),
inside as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as most
           from (select lang, ws, a, k, m, unnest(range(1, k - m + 2)) as i from cand, (select unnest([2, 3]) as m) where m < k) group by 1, 2),
kept as (select w.* from lowest w left join inside i using (lang, phrase) where i.most is null or 100 * i.most::hugeint < 80 * w.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query(OP11)
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(table(spark, folder, "documents"))


@query()
def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"), piece_model(), with_ids=False).drop("ids", "decoded")


OP13 = r"""
with e as (select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
r as (select row_number() over () as uid, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from e),
p as (select a.uid as anchor, a.vec_id as anchor_id, a.label as anchor_label, b.uid as other, b.vec_id as other_id, b.label as other_label,
             cast(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) as bigint) as score
      from r a join r b on a.uid <> b.uid where a.vec_id % 50 = 0),
pos as (select anchor, anchor_id, other as positive, other_id as positive_id, score as positive_score
        from (select *, row_number() over (partition by anchor order by score desc, other_id nulls last, other) as o from p where other_label = anchor_label)
        where o <= 5),
neg as (select pos.*, p.other_id as negative_id, p.score as negative_score,
               row_number() over (partition by anchor, positive order by p.score desc, p.other_id nulls last, p.other) as o
        from pos join p using (anchor) where p.other_label <> p.anchor_label and 50 * positive_score <= 100 * p.score and 100 * p.score <= 95 * positive_score)
select anchor_id, positive_id, cast(o as int) as rank, negative_id, positive_score, negative_score from neg where o <= 3
"""


@query(OP13)
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))
