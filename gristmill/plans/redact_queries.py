"""Queries over redaction and path mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import redact as X
from gristmill.plans import views
from gristmill.plans.registry import query

# the rules in SQL's own words, not the patterns of the operator
_SENSITIVE = r"""(trim({t}) = '' or regexp_matches({t}, '[[:cntrl:]]')
  or regexp_full_match(trim({t}), '0x[0-9a-f]+|[0-9a-f]{8,32}', 'i')
  or regexp_matches(trim({t}), '(^|[ \t?&;,])(api[_-]?key|(access|refresh|auth)[_-]?token|password|passwd|pwd|token|(client[_-]?)?secret|credentials?|authorization)\s*(=|:\s)\s*[^\s,;&]', 'i')
  or regexp_matches(trim({t}), '\b[a-z][a-z0-9+.-]*://[^\s/@]+(:[^\s/@]*)?@', 'i')
  or (contains(upper(trim({t})), '-----BEGIN') and regexp_matches(upper(trim({t})), '-----BEGIN( [A-Z0-9]+)* PRIVATE KEY( BLOCK)?-----')))"""

# besides the texts as they are: every third document opens with a key line, in either case
_LABELLED = """select doc_id, case when doc_id % 6 = 0 then '-----begin rsa private key----- x. ' when doc_id % 6 = 3
  then 'a -----BEGIN PRIVATE KEY BLOCK-----. ' else '' end || text as text from {documents}"""


@query(
    "redact_labels",
    f"""with d as ({_LABELLED.format(documents='documents')}), w as (select doc_id, unnest(string_split(text, '. ')) as label from d), l as (select doc_id, label,
  case when {_SENSITIVE.replace('{t}', 'label')} or regexp_matches(trim(label), '^(/|\\\\\\\\|[A-Za-z]:[\\\\/])') then '[redacted]' else label end as shown from w)
select doc_id, count(*) as labels, count(*) filter (shown = '[redacted]') as redacted, cast(sum(length(shown)) as bigint) as shown_chars
from l group by doc_id""",
)
def redact_labels(spark, sf_dir):
    texts = spark.sql(_LABELLED, documents=views.table(spark, sf_dir, "documents"))
    words = texts.select(
        "doc_id", F.explode(F.split("text", r"\. ")).alias("label")
    )
    shown = words.select("doc_id", X.redact_label(F.col("label")).alias("shown"))
    return shown.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col("shown") == X.REDACTED).alias("redacted"),
        F.sum(F.length("shown")).cast("bigint").alias("shown_chars"),
    )


# source prefixes and where they lead, first fit wins
_PREFIXES = [("https://example.com/", "/srv/example"), ("https:", "/srv/other/"), ("http:", "/srv/plain")]


@query(
    "path_prefix_map",
    """select page_id, case when url = 'https://example.com' or url like 'https://example.com/%' then '/srv/example' || substr(url, 20)
  when url = 'https:' or url like 'https:/%' then '/srv/other' || substr(url, 7)
  when url = 'http:' or url like 'http:/%' then '/srv/plain' || substr(url, 6) else url end as mapped_path from pages""",
)
def path_prefix_map(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return X.map_prefixes(pages, "url", _PREFIXES).drop("url")
