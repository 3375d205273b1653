"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringeworks.llm.common import new_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fringeworks.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.id_store import read_documents, write_ids

    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_documents(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from fringeworks.llm.quality import quality

    # a source is a site, and its first path segment is the language, as in the urls of ``pages``
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return quality(docs, table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.exact_dedup import decisions

    return decisions(table(spark, sf_dir, "documents")).drop("_fw_row")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.url_filters import Rule, judge, site

    sites = [site("block", "net/"), site("allow", "example.net/en/"), site("block", "example.com/de/"), site("allow", "org/fr/")]
    return judge(table(spark, sf_dir, "pages"), [*sites, *(Rule(glob, action) for glob, action in URL_GLOBS.items())])


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fringeworks.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


#: Hosts that advertise, copies for other devices or for print, pages deep in a listing, downloads.
URL_GLOBS = {
    "*spam*/**": "block", "*casino*/**": "block", "ads.*/**": "block", "m.**": "block", "**/print/**": "block", "**/9??": "block",
    "**.exe": "block", "**.zip": "block", "blog.*/en/**": "allow", "**.html": "allow",
}


OP10_SQL = """
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents) d
"""


OP4_SQL = r"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
items as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
sizes as (select *, least(10, len(ws)) as w from items where len(ws) > 0),
wins as (select item_id, w, array_to_string(ws[s:s + w - 1], ' ') as phrase from (select *, unnest(range(1, len(ws) - w + 2)) as s from sizes) x),
grams as (select doc_id, w, p, array_to_string(ws[p:p + w - 1], ' ') as phrase
          from (select doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) as p from docs, (select distinct w from sizes) y where len(ws) >= w) x),
found as (select g.doc_id, g.p, g.w, wins.item_id from grams g join wins using (w, phrase)),
hits as (select doc_id, count(distinct h) as n_hit from (select doc_id, unnest(range(p, p + w)) as h from found) x group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id collate "C") as ids from (select distinct doc_id, item_id from found) x group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)
"""

OP7_SQL = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s from (select *, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from docs where len(ws) > 0) x),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * pairs.n >= 90 * (a.n + b.n - pairs.n)),
reach as (select doc_id, doc_id as c from docs union select links.y, reach.c from reach join links on links.x = reach.doc_id)
select doc_id, coalesce(max(n), 0) as n_shingles, min(c) as component_id from reach left join sizes using (doc_id) group by doc_id
"""


#: crc32 is a fold of shifts; rows of the same conversation and turn number aren't in the given tables.
OP11_SQL = """
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as k, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as t, length(coalesce(text, '')) as points from conversations),
convs as (select conv_id as c, conv_id - conv_id % 100 as base,
                 xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                     lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 as h
          from (select distinct conv_id from conversations) x),
built as (select c, k as rank, t, points from convs join turns on conv_id = base and k <= h union all select c, k + 10 as rank, t, points from convs join turns on conv_id = c and k > h),
placed as (select c, t, points, row_number() over (partition by c order by rank) as d from built),
paths as (select c, 0 as d, 'root' as node, cast(null as varchar) as parent, 0 as points, not exists (select 1 from placed p where p.c = convs.c) as ends from convs
          union all
          select c, d, node, coalesce(lag(node) over (partition by c order by d), 'root') as parent, points, d = max(d) over (partition by c) as ends
          from (select *, sha256(string_agg(t, '' order by d) over (partition by c order by d rows unbounded preceding)) as node from placed) x),
nodes as (select node, d, min(parent) as parent, min(c) as keeper, count(*) as n, count(*) filter (ends) as n_ends, (count(*) - 1) * max(points) as saves,
                 sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256 from paths group by node, d),
below as (select p.node, p.d, sum(m.saves) as saved, count(*) filter (m.n = m.n_ends) as leaves from paths p join nodes m on m.keeper = p.c and m.d >= p.d group by p.node, p.d),
children as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
last as (select p.node, p.d, arg_min(case when p.d <= least(v.h, b.n) then v.base else p.c end, p.c) as turn_conv_id, arg_min(case when p.d <= least(v.h, b.n) then p.d else v.h + p.d - least(v.h, b.n) end, p.c) as turn_place
         from paths p join convs v using (c) join (select c, count(conv_id) as n from convs left join turns on conv_id = base group by c) b using (c) where p.d > 0 group by p.node, p.d)
select x.keeper as conv_id, cast(x.d as bigint) as depth, y.keeper as parent_conv_id, x.n as n_convs, coalesce(children.n, 0) as n_children, cast(below.leaves as bigint) as n_leaves, cast(below.saved as bigint) as saved_tokens, x.ends_sha256,
       cast(turn_conv_id as bigint) as turn_conv_id, cast(turn_place as bigint) as turn_place
from nodes x join below on below.node = x.node and below.d = x.d left join nodes y on y.node = x.parent and y.d = x.d - 1 left join children on children.node = x.node left join last on last.node = x.node and last.d = x.d
"""


def _regex(glob: str) -> str:
    """A glob as a regular expression, for SQL."""
    import re

    parts = {"*": "[^/]*", "**": ".*", "?": "[^/]"}
    return "".join(parts.get(x) or re.escape(x) for x in re.split(r"(\*\*|\*|\?)", glob))


def _op12_sql() -> str:
    literal = {g: len(g.replace("*", "").replace("?", "")) for g in URL_GLOBS}
    first = sorted(URL_GLOBS, key=lambda g: (-literal[g], URL_GLOBS[g] != "block", g))
    fits = {g: f"regexp_full_match(host || path, '{_regex(g)}', 's')" for g in first}
    glob = "case " + " ".join(f"when {fits[g]} then '{g}'" for g in first) + " end"
    return f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
rules(rule_host, rule_path, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(action, length(rule_host || rule_path)) as action
        from parts join rules on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by page_id),
named as (select *, {glob} as found, {" + ".join(f"cast({f} as bigint)" for f in fits.values())} as n_globs from parts)
select page_id, host, path, rule, coalesce(action, case {" ".join(f"when found = '{g}' then '{URL_GLOBS[g]}'" for g in first)} else 'allow' end) as verdict,
       case when rule is null then found end as glob, n_globs
from named left join fit using (page_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_token_counts, op4_decontamination, op5_token_id_output, op6_quality, op7_jaccard_join, op8_repeats, op9_packing, op10_exact_dedup, op11_prefix_trie, op12_url_filters, op13_cross_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_url_filters": _op12_sql()}
