"""The queries of the core engine and their DuckDB counterparts, in build order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import collate, grouping, loss, preprocess, split, stats, triplets
from quarryline.plans.fixtures import FUNCTIONS_SQL, functions_view, raw_view
from quarryline.sources.staging import delete, materialize, shared_folder
from quarryline.sources.tables import read_jsonl, read_table, with_row_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FN = f"fn as ({FUNCTIONS_SQL})"
_LINES = "len(list_filter(string_split(regexp_extract(text, '(?s)\\{(.*)\\}', 1), chr(10)), lambda l: regexp_matches(l, '\\S')))"
_TOKENS = "len(regexp_extract_all(text, '\\w+|[^\\w\\s]'))"
KEPT = f"{FN}, kept as (select * from fn where text <> '' and {_LINES} > 3)"
TOKENS = f"{KEPT}, tokens as (select original_idx, case when text is null or text = '' then -1 else {_TOKENS} end::bigint as token_len from kept)"
KEYED = f"""{FN}, keyed as (select *, regexp_replace(replace(file_name, '_functions', ''), '-[^-]*(-[^-]*)?\\z', '') as source_binary_name from fn),
members as (select original_idx, case when source_binary_name is null or function_name is null then original_idx
  else min(original_idx) over (partition by source_binary_name, function_name) end as group_id from keyed)"""
SPLIT = f"""{KEYED}, sized as (select group_id, count(*) as size from members group by 1),
ranked as (select *, row_number() over (order by md5('42:' || group_id), group_id) - 1 as rank0, count(*) over () as n from sized),
groups as (select group_id, size, rank0, case when rank0 < floor(n::double * 0.9::double) then 'train' else 'validation' end as split from ranked),
idx as (select split, row_number() over (partition by split order by rank0, original_idx) - 1 as new_idx, original_idx, group_id, size
  from members join groups using (group_id))"""
TMAP = f"""{SPLIT}, tmap as (select a.split, a.new_idx as anchor, list(b.new_idx order by b.new_idx) as positives
  from idx a join idx b on a.group_id = b.group_id and a.new_idx <> b.new_idx group by 1, 2),
pool as (select split, count(*) as pool_n from idx group by 1)"""
_H = "('0x' || substr(md5('{t}:42:0:' || anchor), 1, 8))::bigint"
SAMPLE = f"""{TMAP}, drawn as (select split, anchor, positives, list_sort(list_append(positives, anchor)) as ex, pool_n,
  {_H.format(t="p")} as hp, {_H.format(t="n")} as hn from tmap join pool using (split)),
sample as (select split, anchor, positives[hp % len(positives) + 1] as positive,
  list_reduce(ex, lambda acc, x: case when x <= acc then acc + 1 else acc end, hn % (pool_n - len(ex))) as negative
  from drawn where pool_n > len(ex))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _index(spark: SparkSession, d: str) -> DataFrame:
    return split.split_dataset(functions_view(spark, d))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return grouping.normalize_file_name(functions_view(spark, d))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.with_token_len(preprocess.short_function_filter(functions_view(spark, d))).select("original_idx", "token_len")


def _triplets(spark: SparkSession, d: str) -> DataFrame:
    index = materialize(_index(spark, d))
    return triplets.triplet_texts(triplets.triplet_sample(index), split.pools(functions_view(spark, d), index))


def _joined(name: str):
    """An array as text, so that its order takes part in the comparison."""
    return F.array_join(name, ",").alias(name)


@query("row_counts", "select 'documents' as metric, count(*) as n from documents")
def row_counts(spark, d):
    return read_table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("metric"), "n")


@query("short_function_filter", f"with {KEPT} select original_idx from kept")
def short_function_filter(spark, d):
    return preprocess.short_function_filter(functions_view(spark, d)).select("original_idx")


@query("filter_summary", f"with {KEPT} select (select count(*) from fn) as total, (select count(*) from kept) as kept, (select count(*) from fn) - (select count(*) from kept) as removed")
def filter_summary(spark, d):
    return preprocess.filter_summary(functions_view(spark, d))


@query("metadata_extract", f"with {FN} select original_idx, case when original_idx % 13 = 0 then '' else file_name end as file_name, case when original_idx % 13 = 0 then '' else function_name end as function_name from fn")
def metadata_extract(spark, d):
    return preprocess.metadata_extract(raw_view(spark, d)).select("original_idx", "file_name", "function_name")


@query(
    "jsonl_to_processed",
    f"""with {TOKENS} select original_idx, md5(text) as text_md5, token_len, case when original_idx % 13 = 0 then '' else file_name end as file_name,
    case when original_idx % 13 = 0 then '' else function_name end as function_name from kept join tokens using (original_idx) where token_len <> -1""",
)
def jsonl_to_processed(spark, d):
    """The raw records as JSON lines, scanned under the declared schema and processed."""
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    raw_view(spark, d).write.json(path)
    scan = read_jsonl(spark, path, T.StructType([T.StructField("original_idx", T.LongType())]))
    made = materialize(preprocess.preprocess(scan).select("original_idx", F.md5("text").alias("text_md5"), "token_len", "file_name", "function_name"))
    delete(spark, path)
    return made


@query("dense_index", "select count(*) as n, count(*) as numbers, case when count(*) > 0 then 0::bigint end as lowest, case when count(*) > 0 then count(*) - 1 end as highest from documents")
def dense_index(spark, d):
    """Which row has which number depends on the scan, so what makes the index dense is compared."""
    i = F.col("original_idx")
    made = with_row_index(read_table(spark, d, "documents").select("doc_id"))
    return made.agg(F.count(i).alias("n"), F.count_distinct(i).alias("numbers"), F.min(i).alias("lowest"), F.max(i).alias("highest"))


@query("token_len", f"with {TOKENS} select * from tokens")
def token_len(spark, d):
    return _tokens(spark, d)


@query("valid_token_filter", f"with {TOKENS} select * from tokens where token_len <> -1")
def valid_token_filter(spark, d):
    return preprocess.valid_token_filter(_tokens(spark, d))


_Q = ", ".join(f"round(quantile_cont(token_len, {v}), 6) as {k}" for k, v in stats.PERCENTILES.items())


@query("token_stats", f"with {TOKENS} select count(*) as n, min(token_len) as min, max(token_len) as max, round(avg(token_len), 6) as mean, {_Q} from tokens")
def token_stats(spark, d):
    return stats.token_stats(_tokens(spark, d))


_CDF = "select token_len, round((row_number() over (order by token_len) - 1)::double / nullif(count(*) over () - 1, 0), 9) as y from tokens"


@query("token_cdf", f"with {TOKENS} {_CDF}")
def token_cdf(spark, d):
    return stats.token_cdf(_tokens(spark, d))


@query("cdf_display_limit", f"with {TOKENS}, cdf as ({_CDF}), cut as (select quantile_cont(token_len, 0.995) as c from tokens) select token_len, y, token_len between 0 and c as shown from cdf, cut")
def cdf_display_limit(spark, d):
    return stats.cdf_display_limit(_tokens(spark, d)).select("token_len", "y", "shown")


@query("text_preview", "select doc_id, substr(text, 1, 50) as preview from documents")
def text_preview(spark, d):
    return preprocess.text_preview(read_table(spark, d, "documents").select("doc_id", "text"))


@query("normalize_file_name", f"with {KEYED} select original_idx, source_binary_name from keyed")
def normalize_file_name(spark, d):
    return _keyed(spark, d).select("original_idx", "source_binary_name")


_GROUPS = "select source_binary_name, function_name, count(*) as n from keyed where source_binary_name is not null and function_name is not null group by 1, 2"


@query("function_groups", f"with {KEYED} {_GROUPS}")
def function_groups(spark, d):
    return grouping.function_groups(_keyed(spark, d))


@query("multi_member_groups", f"with {KEYED} {_GROUPS} having count(*) > 1")
def multi_member_groups(spark, d):
    return grouping.multi_member_groups(_keyed(spark, d))


@query("positive_pairs", f"with {KEYED} select a.original_idx as idx1, b.original_idx as idx2 from keyed a join keyed b using (source_binary_name, function_name) where a.original_idx < b.original_idx")
def positive_pairs(spark, d):
    return grouping.positive_pairs(_keyed(spark, d))


@query("positive_map", f"with {KEYED} select a.original_idx, string_agg(b.original_idx, ',' order by b.original_idx) as positives from keyed a join keyed b using (source_binary_name, function_name) where a.original_idx <> b.original_idx group by 1")
def positive_map(spark, d):
    return grouping.positive_map(_keyed(spark, d)).select("original_idx", _joined("positives"))


@query("components", f"with {KEYED} select * from members")
def components(spark, d):
    return grouping.components(_keyed(spark, d))


@query("group_split", f"with {SPLIT} select group_id, rank0, split from groups")
def group_split(spark, d):
    return split.group_split(grouping.components(_keyed(spark, d))).select("group_id", "rank0", "split")


@query("split_summary", f"with {SPLIT} select split, count(*) as n, count(distinct group_id) as groups, count(*) filter (size > 1) as anchors from idx group by 1")
def split_summary(spark, d):
    return split.split_summary(_index(spark, d))


@query("split_disjoint", f"with {SPLIT} select count(*) as overlap from (select group_id from idx group by 1 having count(distinct split) > 1)")
def split_disjoint(spark, d):
    return split.split_disjoint(_index(spark, d))


@query("reindex", f"with {SPLIT} select split, new_idx, original_idx from idx")
def reindex(spark, d):
    return _index(spark, d).select("split", "new_idx", "original_idx")


@query("translate_map", f"with {TMAP} select split, anchor, array_to_string(positives, ',') as positives from tmap")
def translate_map(spark, d):
    made = split.translate_map(_index(spark, d))
    return made.select("split", "anchor", _joined("positives"))


@query("pools", f"with {SPLIT} select split, new_idx, md5(text) as text_md5, file_name, function_name from idx join fn using (original_idx)")
def pools(spark, d):
    made = split.pools(functions_view(spark, d), _index(spark, d))
    return made.select("split", "new_idx", F.md5("text").alias("text_md5"), "file_name", "function_name")


@query("point_lookup", f"with {FN} select original_idx, text from fn where original_idx = 7")
def point_lookup(spark, d):
    return triplets.point_lookup(functions_view(spark, d), 7)


@query("first_anchors", f"with {TMAP} select anchor from tmap where split = 'train' order by 1 limit 4")
def first_anchors(spark, d):
    return triplets.first_anchors(_index(spark, d))


@query("negative_candidates", f"with {TMAP} select split, anchor, pool_n - len(positives) - 1 as candidates from tmap join pool using (split)")
def negative_candidates(spark, d):
    return triplets.negative_candidates(_index(spark, d))


@query("triplet_sample", f"with {SAMPLE} select * from sample")
def triplet_sample(spark, d):
    return triplets.triplet_sample(_index(spark, d))


@query(
    "triplets",
    f"""with {SAMPLE}, texts as (select split, new_idx, text from idx join fn using (original_idx))
    select s.split, s.anchor as anchor_idx, md5(a.text) as anchor, md5(p.text) as positive, md5(n.text) as negative from sample s
    join texts a on a.split = s.split and a.new_idx = s.anchor join texts p on p.split = s.split and p.new_idx = s.positive
    join texts n on n.split = s.split and n.new_idx = s.negative""",
)
def triplet_rows(spark, d):
    return _triplets(spark, d).select("split", "anchor_idx", *[F.md5(r).alias(r) for r in collate.ROLES])


@query("instruction_prefix", f"select doc_id, md5('{collate.INSTRUCTION}' || text) as text_md5 from documents")
def instruction_prefix(spark, d):
    made = collate.instruction_prefix(read_table(spark, d, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.md5("text").alias("text_md5"))


_IDS = "list_transform(string_split(text, ' '), lambda w: length(w))"


_PAD = f"list_transform(range({collate.MAX_LENGTH} - len(ids)), lambda x: 0)"
_FITTED = f"""with cut as (select doc_id, list_slice({_IDS}, 1, {collate.MAX_LENGTH}) as ids from documents),
fitted as (select doc_id, list_concat({_PAD}, ids) as input_ids, list_concat({_PAD}, list_transform(ids, lambda x: 1)) as attention_mask from cut)"""


def _word_lengths(text):
    """They stand in for token ids."""
    return F.transform(F.split(text, " ", -1), lambda w: F.length(w))


def _ids(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", _word_lengths(F.col("text")).alias("ids"))


@query(
    "truncate_pad",
    f"""{_FITTED} select doc_id, md5(array_to_string(input_ids, ',')) as input_ids, md5(array_to_string(attention_mask, ',')) as attention_mask from fitted""",
)
def truncate_pad(spark, d):
    made = collate.truncate_pad(_ids(spark, d))
    return made.select("doc_id", *[F.md5(_joined(x)).alias(x) for x in ("input_ids", "attention_mask")])


@query("length_check", f"{_FITTED} select count(*) filter (len(input_ids) <> {collate.MAX_LENGTH})::bigint as wrong from fitted")
def length_check(spark, d):
    return collate.wrong_lengths(collate.truncate_pad(_ids(spark, d)))


def _role_sql(role: str) -> str:
    words = f"string_split('{collate.INSTRUCTION}' || {role}.text, ' ')"
    ids = f"list_slice(list_transform({words}, lambda w: length(w)), 1, {collate.MAX_LENGTH})"
    pad = f"list_transform(range({collate.MAX_LENGTH} - len({ids})), lambda x: 0)"
    ones = f"list_transform({ids}, lambda x: 1)"
    return ", ".join(f"md5(array_to_string(list_concat({pad}, {x}), ',')) as {role}_{name}" for name, x in (("input_ids", ids), ("attention_mask", ones)))


@query(
    "collate",
    f"""with {SAMPLE}, texts as (select split, new_idx, text from idx join fn using (original_idx))
    select s.split, s.anchor as anchor_idx, {", ".join(map(_role_sql, collate.ROLES))} from sample s
    join texts anchor on anchor.split = s.split and anchor.new_idx = s.anchor join texts positive on positive.split = s.split and positive.new_idx = s.positive
    join texts negative on negative.split = s.split and negative.new_idx = s.negative""",
)
def collate_triplets(spark, d):
    """The six arrays of every triplet, as digests."""
    made = collate.collate(_triplets(spark, d), _word_lengths)
    return made.select("split", "anchor_idx", *[F.md5(_joined(f"{r}_{x}")).alias(f"{r}_{x}") for r in collate.ROLES for x in ("input_ids", "attention_mask")])


def _hidden(spark, d):
    """Vectors as sequences of 16 steps of 4; the mask's length varies with the id, and one batch pads right."""
    e = read_table(spark, d, "embeddings")
    hidden = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    n = (F.col("vec_id") % 16).cast("int")
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(16) - n)
    left = F.concat(F.array_repeat(F.lit(0), F.lit(15) - n), F.array_repeat(F.lit(1), n + 1))
    mask = F.when(F.col("vec_id") % 4 == 0, F.concat(ones, zeros)).otherwise(left)
    return e.select((F.col("vec_id") % 4).alias("batch"), F.col("vec_id").alias("id"), hidden.alias("hidden"), mask.alias("mask"))


@query(
    "last_token_pool",
    """with r as (select vec_id, embedding, vec_id % 4 as batch, case when vec_id % 4 = 0 then (case when vec_id % 16 = 0 then 16 else vec_id % 16 end) else 16 end as p from embeddings)
    select batch, vec_id as id, array_to_string(list_transform(list_slice(embedding, (p - 1) * 4 + 1, p * 4), lambda x: (round(x::double * 1000000))::bigint), ',') as embedding from r""",
)
def last_token_pool(spark, d):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long"))
    return loss.last_token_pool(_hidden(spark, d)).select("batch", "id", F.array_join(rounded, ",").alias("embedding"))


_NORM = "list_transform({v}, lambda x: x::double / greatest(sqrt(list_sum(list_transform({v}, lambda y: y::double * y::double))), 1e-8::double))"


@query("l2_normalize", f"select vec_id, list_sum(list_transform({_NORM.format(v='embedding')}, lambda x: (round(x * 1000000))::bigint))::bigint as total from embeddings")
def l2_normalize(spark, d):
    made = loss.l2_normalize(read_table(spark, d, "embeddings").select("vec_id", "embedding"))
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: acc + F.round(x * 1000000).cast("long"))
    return made.select("vec_id", total.alias("total"))


_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(z[1]::double - z[2]::double + 1e-6::double, 2))))"


@query(
    "triplet_loss",
    f"""with v as (select vec_id, label, embedding, lead(embedding) over (partition by label order by vec_id) as pos,
    lead(embedding) over (order by vec_id % 7, vec_id) as neg from embeddings)
    select round(avg(greatest({_DIST.format(a="embedding", b="pos")} - {_DIST.format(a="embedding", b="neg")} + 1.0::double, 0.0::double)), 6) as loss
    from v where pos is not null and neg is not null""",
)
def triplet_loss(spark, d):
    """The next vector of a label is the positive, the next one in the order of (id mod 7, id)
    the negative. Each remainder is ordered by itself; its last vector is followed by the first
    of the next remainder that there is, so that no window holds all vectors."""
    e = read_table(spark, d, "embeddings").withColumn("r", F.col("vec_id") % 7)
    firsts = e.groupBy("r").agg(F.min_by("embedding", "vec_id").alias("first"))  # 7 rows at most
    after = firsts.select("r", F.lead("first").over(Window.orderBy("r")).alias("after"))
    following = F.lead("embedding").over(Window.partitionBy("r").orderBy("vec_id"))
    e = e.withColumn("positive", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).withColumn("following", following)
    e = e.join(F.broadcast(after), "r").withColumn("negative", F.coalesce("following", "after"))
    rows = e.filter("positive is not null and negative is not null").withColumnRenamed("embedding", "anchor")
    return loss.triplet_loss(rows, digits=6)
