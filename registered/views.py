"""Ticket data derived from the given tables, as SQL both engines read alike.

`{events}` and the like stand for the tables.  Every view reads its whole
tables; what differs between rows is decided by their own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BY_EVENT = """case event_type when 'view' then 'Product Issue' when 'error' then 'Software Issue'
    when 'click' then 'Network Issue' when 'purchase' then 'Battery Issue' end"""

# Tickets: sign-ups are unclassified; high and low values have been reviewed.
TICKETS = f"""
select event_id as id,
  'ticket ' || cast(event_id as string) as title,
  event_type || ' by user ' || cast(user_id as string) as description,
  {_BY_EVENT} as predicted_category,
  case when value > 150 then 'General Question' when value < 20 then {_BY_EVENT} end as actual_category,
  case when event_type <> 'signup' then least(value / 100, cast(1 as double)) end as confidence_score,
  case when event_type <> 'signup' then 'seeded' end as reasoning,
  case when value > 150 or (value < 20 and event_type <> 'signup') then 'corrected'
    when event_type = 'signup' then 'open' else 'classified' end as status,
  ts as created_at, ts as updated_at
from {{events}}"""

# Corrections: several per ticket, some of unknown tickets, some not allowed.
CORRECTIONS = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
    cast(l_partkey as string), cast(l_suppkey as string)) as correction_id,
  l_orderkey as ticket_id,
  case l_returnflag || l_linestatus when 'RO' then 'Product Issue' when 'RF' then 'Software Issue'
    when 'AF' then 'Network Issue' when 'AO' then 'Battery Issue' when 'NO' then 'General Question'
    else 'Billing' end as corrected_category,
  case when l_discount > 0.095 then repeat('too long ', 200) when l_tax > 0.04 then 'wrong label' end as feedback,
  l_shipdate as corrected_at
from {lineitem}"""

# Feedback log, with rows of tickets that do not exist.
FEEDBACK = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
    cast(l_partkey as string), cast(l_suppkey as string)) as id,
  l_orderkey as ticket_id,
  case when l_tax > 0.06 then null when l_linestatus = 'O' then 'Network Issue' else 'Battery Issue' end as old_label,
  case l_returnflag when 'R' then 'Product Issue' when 'A' then 'Software Issue' else 'General Question' end as new_label,
  cast(null as string) as feedback, l_shipdate as created_at
from {lineitem}"""

# Incoming tickets: null, empty, normal and over-long titles; texts of any length.
INTAKE = """
select doc_id as id,
  case when lang = 'de' then null when lang = 'fr' then ''
    when lang = 'es' and n_chars > 1500 then repeat(source || ' ', 60) else source || ' ' || lang end as title,
  text as description,
  timestamp '2024-01-01 00:00:00' + cast(doc_id as int) * interval '1' hour as created_at
from {documents}"""

# Vectors; label 9 has no category.
VECTORS = """
select e.vec_id as id, d.text as document,
  case when e.label < 9 then 'label_' || cast(e.label as string) end as category, e.embedding,
  timestamp '2024-01-01 00:00:00' + cast(e.vec_id as int) * interval '1' hour as created_at
from {embeddings} e left join {documents} d on d.doc_id = e.vec_id"""

# Requests to the memo, one key per user and kind of event.
REQUESTS = """
select event_id as request_id, cast(user_id as string) || ':' || event_type as key, ts from {events}"""

# Requests keyed by user, and a memo that purchases write to.
USER_REQUESTS = """
select event_id as request_id, cast(user_id as string) as key, ts from {events}"""
MEMO = """
select cast(user_id as string) as key, ts as written_at, props as label
from {events} where event_type = 'purchase'"""

# Model answers, good and bad, for the labelled documents.
ANSWERS = """
select d.doc_id as ticket_id, case
  when d.lang = 'en' and l.quality = 1 and l.toxic = 0
    then '{{"category":"Network Issue","confidence":0.9,"reasoning":"r","key_indicators":["a","b"]}}'
  when d.lang = 'en' and l.quality = 0 and l.toxic = 0
    then '{{"category":"a BATTERY issue, surely","confidence":"0.8","reasoning":"r","key_indicators":[]}}'
  when d.lang = 'en' and l.quality = 1 then '{{"category":"Billing","confidence":1.7}}'
  when d.lang = 'en' then 'not json'
  when d.lang = 'es' and l.quality = 1 then '{{"category":"Product Issue"}}'
  when d.lang = 'es' then '{{"category":"Product Issue","confidence":null}}'
  when d.lang = 'fr' and l.quality = 1 and l.toxic = 0 then '{{"category":"Product Issue","confidence":"high"}}'
  when d.lang = 'fr' then '{{"category":["Network Issue"],"confidence":-1}}'
  when d.lang = 'de' and l.quality = 1 then '{{"category":"Battery Issue","confidence":0.75,"reasoning":"fits"}}'
  else '[1]' end as raw
from {documents} d join {labels} l on l.doc_id = d.doc_id"""

# Words by language: the scorer under load, as the support words hardly occur.
LANGUAGE_RULES = {
    "French": ["eau", "ou", "que", "ment", "tion"],
    "English": ["the", "and", "er", "on", "sh"],
    "German": ["ich", "ung", "sch", "ein", "der"],
    "Spanish": ["ado", "ción", "los", "que", "mente"],
}

_TABLES = ["events", "documents", "embeddings", "labels", "lineitem"]


def for_duckdb(view: str) -> str:
    return view.format(**{t: t for t in _TABLES})


class Given:
    """The given tables of one folder and the views over them, in Spark."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, sql: str) -> DataFrame:
        used = {t: self.table(t) for t in _TABLES if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **used)

    def tickets(self) -> DataFrame:
        return self._view(TICKETS)

    def corrections(self) -> DataFrame:
        return self._view(CORRECTIONS)

    def feedback(self) -> DataFrame:
        return self._view(FEEDBACK)

    def intake(self) -> DataFrame:
        return self._view(INTAKE).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))

    def vectors(self) -> DataFrame:
        return self._view(VECTORS).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))

    def requests(self) -> DataFrame:
        return self._view(REQUESTS)

    def user_requests(self) -> DataFrame:
        return self._view(USER_REQUESTS)

    def memo(self) -> DataFrame:
        return self._view(MEMO).select("key", "written_at", F.struct("label").alias("result"))

    def answers(self) -> DataFrame:
        return self._view(ANSWERS)
