"""One query per corpus operator over the given tables, with its DuckDB answer where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.llm import blob_ledger, factorisation, line_chunks, metric_trees, mixing, prefix_trie, quality, sharding, simhash, templates, token_files, toxicity, warc
from tapewatch.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = "'0123456789abcdef'"
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: near duplicates

@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# 2: archives

@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = scratch(spark, "records")
    warc.read_archives(spark, path).write.parquet(records)
    return warc.resolved(spark.read.parquet(records), path)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::int >> {shift}) % 32 + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))
ORACLE["op2_warc"] = f"""
with p as (
    select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first
    from pages)
select page_id, strlen(t)::bigint as payload_bytes, {_BASE32} as payload_digest,
    if(page_id = first, 'response', 'revisit') as record_type, if(page_id = first, null, first) as refers_to
from p
"""


# 3: token ids

@query
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.encoded(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(spark, path, "long")


# 4: quality rules

@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


ORACLE["op4_quality_rules"] = rf"""
with w as (
    select doc_id, coalesce(text, '') as t, {SQL_WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from documents),
windows as (
    select r, i, count(*) over (partition by r, g) as n
    from (
        select r, i, array_to_string(w[i:i + 4], ' ') as g
        from (select r, w, unnest(range(1, len(w) - 3)) as i
              from (select row_number() over () as r, w from (select distinct w from w)) where len(w) >= 5))),
covered as (
    select r, count(distinct i + k) as n_repeat_words
    from windows, (select unnest(range(5)) as k) where n > 1 group by r),
repeated as (
    select w, n_repeat_words
    from covered join (select row_number() over () as r, w from (select distinct w from w)) using (r)),
stats as (
    select doc_id, t, w.w, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from w left join repeated on w.w = repeated.w)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words
        or 10 * n_symbols > n_words
        or 2 * n_dup_lines > n_lines
        or 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 7 * n_words
        or len(regexp_extract_all(t, '\p{{Lu}}')) > len(regexp_extract_all(t, '\p{{Ll}}'))
        or word_chars > 15 * n_words or word_chars < 2 * n_words) as kept
from stats
"""


# 5: mixing

@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns, rows = mixing.replicated(docs)
    # the digest is taken of what has come through the shuffle: whole documents, as in the pipeline
    return rows.select(
        columns["doc_id"].alias("doc_id"), columns["source"].alias("source"), "n_copies", "copy", "order_key",
        F.md5(F.coalesce(columns["text"], F.lit(""))).alias("text_md5"))


ORACLE["op5_mixing"] = f"""
with s as (
    select source, sum(strlen(coalesce(text, '')))::bigint as bytes from documents group by source),
w as (
    select source, bytes, sqrt(bytes::double) as weight, sum(bytes) over () as total, sum(sqrt(bytes::double)) over () as weights from s),
r as (
    select source, if(bytes > 0, weight / weights * total / bytes, 0.0) as rate from w),
p as (
    select source, rate, greatest(1, ceil(rate / {mixing.LARGEST_RATE}))::int as parts from r),
c as (
    select source, parts, k, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1)) over (partition by source order by k) as cumulated
    from p, (select unnest(range({mixing.STEPS})) as k)),
d as (
    select row_number() over () as row, doc_id, source, md5(coalesce(text, '')) as t from documents),
u as (
    select row, d.source, ('0x' || substr(md5('{mixing.SEED}:' || j || ':' || coalesce(doc_id::varchar, '') || ':' || t), 1, 13))::bigint
        / 4503599627370496.0::double as u
    from d join (select source, unnest(range(parts)) as j from p) x on d.source is not distinct from x.source),
n as (
    select row, count(*)::int as n_copies from u join c on u.source is not distinct from c.source where cumulated <= u group by row)
select doc_id, source, n_copies, copy::int as copy, md5('order {mixing.SEED}:' || coalesce(doc_id::varchar, '') || ':' || t || ':' || copy) as order_key, t as text_md5
from (select doc_id, source, t, n_copies, unnest(range(1, n_copies + 1)) as copy from d join n using (row))
"""


# 6: sharding

@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = {name: F.col(f"row._{docs.columns.index(name)}") for name in ("doc_id", "text")}
    text = F.coalesce(at["text"], F.lit(""))
    return sharding.sharded(docs, 8).select(
        at["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# 7: benchmark decontamination

@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")


_SQL_UNITS = ", ".join(f"'{u}'" for u in templates.UNITS)
_SQL_TOKENS = rf"""
    select id, raw, i, case
        when regexp_full_match(raw, '\p{{N}}.*') then '{templates.NUMBER}'
        when lower(raw) in ({_SQL_UNITS}) then '{templates.UNIT}'
        when not start and regexp_full_match(raw, '\p{{Lu}}\p{{L}}+') then '{templates.NAME}'
        else lower(raw) end as token
    from (
        select id, raw, start, row_number() over (partition by id order by k) - 1 as i
        from (
            select id, raw, k, coalesce(lag(raw) over (partition by id order by k) in ('.', '!', '?', chr(10)), true) as start
            from (select id, unnest(l) as raw, unnest(range(len(l))) as k
                  from (select id, regexp_extract_all(text, '{templates.TOKEN.replace(chr(92) + "n", "' || chr(10) || '")}') as l from x)))
        where raw not in ('.', '!', '?', chr(10)))
"""
_SQL_WINDOWS = f"""
    select id, i as at, size, array_to_string(ts[1:size], ' ') as template,
        list_filter(list_transform(range(1, size + 1), lambda k: if(ts[k] in ('{templates.NUMBER}', '{templates.UNIT}', '{templates.NAME}'),
            ts[k] || ' ' || lower(rs[k]), null)), lambda s: s is not null) as slots
    from (
        select id, i, least({templates.WINDOW}, n) as size, ts, rs
        from (
            select id, i, count(*) over (partition by id) as n, list(token) over w as ts, list(raw) over w as rs
            from t window w as (partition by id order by i rows between current row and {templates.WINDOW - 1} following))
        where i <= n - least({templates.WINDOW}, n))
"""
# items of the given tables are longer than a window, so documents need windows of one size only
ORACLE["op7_decontamination"] = f"""
with b as (
    with x as (select min(item_id) as id, text from benchmark group by text), t as ({_SQL_TOKENS}) {_SQL_WINDOWS}),
bw as (
    select *, count(*) over (partition by id) as n_windows from b where size - len(slots) >= least({templates.LEAST_WORDS}, size)),
dw as (
    with x as (select doc_id as id, text from documents), t as ({_SQL_TOKENS}) {_SQL_WINDOWS}),
m as (
    select dw.id as doc_id, bw.id as item_id, n_windows, dw.at - bw.at as diagonal, bw.at as item_at, bw.slots as item_slots, dw.slots as doc_slots
    from dw join bw using (template, size)),
pairs as (
    select distinct doc_id, item_id, diagonal, unnest(item_slots) as item_slot, unnest(doc_slots) as doc_slot from m),
judged as (
    select doc_id, item_id, diagonal, bool_or(item_slot != doc_slot) as other,
        count(distinct item_slot) = count(*) and count(distinct doc_slot) filter (starts_with(item_slot, '{templates.NAME}'))
            = count(*) filter (starts_with(item_slot, '{templates.NAME}')) as good
    from pairs group by all),
kept as (
    select m.*, coalesce(other, false) as other from m left join judged using (doc_id, item_id, diagonal) where coalesce(good, true))
select doc_id, item_id, n_windows::int as n_windows, count(distinct item_at)::int as n_found, bool_or(other) as new_values
from kept group by doc_id, item_id, n_windows having count(distinct item_at) >= {templates.LEAST_SHARE} * n_windows
"""


# 8: toxicity

@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# 9: secret scans

@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.scan(table(spark, sf_dir, "documents"), scratch(spark, "ledger"))
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k.name}")
              for i, k in enumerate(blob_ledger.KINDS)]
    told = blob_ledger.told(spans)
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(told, 256).alias("base_sha256"), told.alias("spans"))


_SECRET_KINDS = "\nunion all\n".join(rf"""
    select row, {i} as kind, '{k.name}' as name, unnest(starts) as start, unnest(ends) as stop, unnest(counts) as counts
    from (
        select row, list_transform(m, lambda x, i: length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i - 1], ''))) as starts,
            list_transform(m, lambda x, i: length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i], ''))) as ends,
            list_transform(g, lambda x: length(x) >= {k.least}) as counts
        from (
            select row, regexp_extract_all(t, p, 0) as m, string_split_regex(t, p) as b, regexp_extract_all(t, p, {k.group}) as g
            from (select row, t, '{base.replace("'", "''")}' as p from d where regexp_matches(t, '{k.hint.replace("'", "''")}'))))""" for i, (k, base) in enumerate(zip(
                blob_ledger.KINDS, (blob_ledger.KINDS[0].pattern, "AKIA[A-Z0-9]+", "[0-9a-f]+"), strict=True)))
ORACLE["op9_secret_scan"] = f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
found as ({_SECRET_KINDS}),
told as (
    select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
        string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as spans
    from found where counts group by row)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
    coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (row)
"""


# 10: line dedup

@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col(f"row._{docs.columns.index('text')}"), F.lit(""))
    return line_chunks.remove_repeats(docs).select(
        F.col(f"row._{docs.columns.index('doc_id')}").alias("doc_id"), "n_lines", "n_removed_lines",
        F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


ORACLE["op10_line_dedup"] = rf"""
with d as (
    select doc_id, text, row_number() over () as row, string_split(text, chr(10)) as l from documents),
lines as (
    select row, doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as i, len(l) as n from d where text is not null),
hashed as (
    select *, ('0x' || substr(md5(line), 1, 15))::bigint % 1099511627776 as h,
        length(line) - length(replace(line, ' ', '')) >= {line_chunks.LONG_LINE_WORDS - 1} as long
    from lines),
rolled as (
    select *, coalesce(lag(h) over w, 0) * {line_chunks.FACTOR} + h as r from hashed window w as (partition by row order by i)),
starts as (
    select *, i = 1 or long or lag(long) over w
        or i > 2 and lag(r) over w < lag(r, 2) over w and lag(r) over w < r as starts
    from rolled window w as (partition by row order by i)),
numbered as (
    select *, sum(starts::int) over (partition by row order by i) as k from starts),
chunks as (
    select row, any_value(doc_id) as doc_id, k, string_agg(line, chr(10) order by i) as chunk, count(*) as n_lines,
        count(*) > 1 or bool_or(long) as counts
    from numbered group by row, k),
-- equal ids with unequal texts do not occur in the given tables, so (doc_id, k) orders the occurrences
judged as (
    select *, counts and (doc_id, k) != min((doc_id, k)) over (partition by counts, chunk) as gone from chunks),
told as (
    select row, sum(n_lines)::bigint as n_lines, sum(if(gone, n_lines, 0))::bigint as n_removed_lines,
        coalesce(string_agg(chunk, chr(10) order by k) filter (not gone), '') as kept
    from judged group by row)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed_lines, 0)::bigint as n_removed_lines,
    length(coalesce(kept, ''))::bigint as kept_chars, sha256(coalesce(kept, '')) as kept_sha256
from d left join told using (row)
"""


# 11: conversation prefix trie

@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_CRC32_STEP = "lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)"
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''),
    lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), {_CRC32_STEP}), 4294967295)"""
ORACLE["op11_prefix_trie"] = f"""
with t as (
    select conv_id::bigint as conv_id, turn, strlen(coalesce(text, ''))::bigint as size,
        substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as digest
    from conversations where conv_id is not null),
own as (
    select conv_id, list(struct_pack(digest := digest, size := size) order by turn nulls first, digest, size) as own from t group by conv_id),
head as (select *, conv_id - conv_id % 5 as base, {_CRC32} % 9 as h from own),
whole as (
    select head.conv_id, list_concat(coalesce(b.own, [])[1:h], head.own[h + 1:]) as turns
    from head left join own b on b.conv_id = base),
prefixes as (
    select conv_id, d, len(turns) = d as ends, coalesce(turns[d].size, 0) as size,
        array_to_string(list_transform(turns[1:d], lambda x: x.digest), '') as node
    from (select *, unnest(range(len(turns) + 1)) as d from whole)),
nodes as (
    select node, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
    from prefixes group by node, d),
children as (select substr(node, 1, 32 * (d - 1)::int) as node, count(*) as n_children from nodes where d > 0 group by 1),
told as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)),
below as (
    select substr(node, 1, 32 * k::int) as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
    from (select *, unnest(range(d + 1)) as k from told) group by 1)
select told.conv_id, told.d::bigint as depth, up.conv_id as parent_conv_id, told.n_convs::bigint as n_convs,
    told.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, told.ends_sha256
from told join below using (node) left join nodes up on told.d > 0 and up.node = substr(told.node, 1, 32 * (told.d - 1)::int)
"""


# 12: vector code compression

@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = metric_trees.compressed(table(spark, sf_dir, "embeddings"))
    return metric_trees.with_label_error(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(metric_trees.digest(codebooks)).alias("codebooks_sha256"))


def _assigned(i: int) -> str:
    """Each part's nearest entry: without the part's own square, which is the same for all entries."""
    return f"""
a{i} as materialized (
    select row, p, arg_min(e, (far, e)) as e, min(far) as far
    from (select row, p, e, list_inner_product(c, c) - 2 * list_inner_product(x, c) as far from parts join c{i} using (p)) group by row, p)"""


def _moved(i: int) -> str:
    return f"""
c{i + 1} as materialized (
    select p, e, coalesce(m, c) as c
    from c{i} left join (
        select p, e, list(floor(total / n) order by j) as m
        from (select p, e, j, sum(x[j]) as total, count(*) as n
              from (select p, e, x, unnest(range(1, len(x) + 1)) as j from parts join a{i} using (row, p)) group by p, e, j)
        group by p, e) using (p, e))"""


ORACLE["op12_vector_codes"] = f"""
with kept as materialized (
    select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: floor({metric_trees.SCALE} * x::double)) as v
    from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
    select row, p, v[p * w + 1:(p + 1) * w] as x
    from (select *, len(v) // {metric_trees.PARTS} as w, unnest(range({metric_trees.PARTS})) as p from kept)),
c0 as materialized (
    select p, e, x as c
    from (select p, x, row_number() over (partition by p order by vec_id, v) - 1 as e from parts join kept using (row))
    where e < {metric_trees.ENTRIES}),
{",".join(_assigned(i) + "," + _moved(i) for i in range(metric_trees.ROUNDS))},
{_assigned(metric_trees.ROUNDS)},
codes as (
    select row, string_agg(printf('%02x', e), '' order by p) as code, sum(far + list_inner_product(x, x))::bigint as error
    from a{metric_trees.ROUNDS} join parts using (row, p) group by row),
books as (
    select sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::bigint::varchar), 'string_agg', ','), ',' order by p, e)) as codebooks_sha256
    from c{metric_trees.ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from codes join kept using (row), books
"""


# 13: quality classifier

@query
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = factorisation.fit(docs, table(spark, sf_dir, "labels"))
    return factorisation.score(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
