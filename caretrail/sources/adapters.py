"""Event frames from the shared test tables, and tables that belong to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Projection of a table of web events on to coded clinical events; the same text is SQL
#: for other engines.
K = """cast(replace(replace(props, '{"k": ', ''), '}', '') as int)"""
CODE = """case
 when event_type='signup' then case k%10 when 0 then 'HOSPITAL_ADMISSION//EW EMER.//EMERGENCY ROOM' when 1 then 'ED_REGISTRATION'
   when 2 then 'TRANSFER_TO//admit//Medical Intensive Care Unit (MICU)' when 3 then 'TRANSFER_TO//transfer//PACU' when 4 then 'TRANSFER_TO//ED//Emergency Department'
   when 5 then 'ICU_ADMISSION//MICU' when 6 then 'STRUCT_START_OR' when 7 then '221906' when 8 then 'CPR_EVENT' else 'TRANSFER_TO//transfer//Medicine' end
 when event_type='error' then case when k=3 then 'MEDS_DEATH' when k%10=0 then 'HOSPITAL_DISCHARGE//HOME' when k%10=1 then 'ICU_DISCHARGE//MICU' when k%10=2 then 'ED_OUT'
   when k%10=4 then 'Event//Code Blue activated' when k%10=5 then 'STRUCT_END_OR' when k%10=6 then '227194' else 'ADMIN_NOTE//'||cast(k as varchar(10)) end
 when event_type='view' then case when k>=97 then case k when 97 then 'Weight (Lbs)' when 98 then 'Height (Inches)' else 'BMI (kg/m2)' end
   when k%20=19 then 'LAB//'||cast(50000+k as varchar(10))||'//UNK' when k%20=18 then 'Blood Pressure' else 'LAB//'||cast(50000+k%20 as varchar(10))||'//mg/dL' end
 when event_type='click' then case k%8 when 0 then 'MEDICATION//START//DRUG '||cast(k as varchar(10)) when 1 then 'MEDICATION//Acetaminophen//Administered' when 2 then 'INFUSION_START//225158'
   when 3 then 'INFUSION_END//225158' when 4 then 'NDC//0002-1200-80' when 5 then 'RXNORM//161' when 6 then 'MEDICATION//STOP//DRUG '||cast(k as varchar(10)) else 'MEDICATION//Hydromorphone (Dilaudid)//Administered' end
 else case k%8 when 0 then 'DIAGNOSIS//ICD//10//E119' when 1 then 'DIAGNOSIS//ICD//9//25000' when 2 then 'ICD10CM//A12.3' when 3 then 'PROCEDURE//ICD//10//0JH60DZ' when 4 then 'PROCEDURE//CPT//99213'
   when 5 then 'PROCEDURE//START//CT scan' when 6 then 'DIAGNOSIS//ICD//9//V5867' else 'DIAGNOSIS//ICD//10//'||'Z'||cast(k as varchar(10)) end end"""
VALUE = "case when event_type='view' and k%20 in (18,19) and k<97 then null else value end"


#: Events of a task, on average, where histories are many; below so many tasks' worth of
#: events the session's own shuffle is left as it is.
TASK_EVENTS, TASKS = 131_072, 16


def many(rows: int) -> bool:
    """Whether so many events are ``dealt``."""
    return -(-rows // TASK_EVENTS) >= TASKS


def dealt(events: DataFrame, rows: int) -> DataFrame:
    """Events by subject over as many partitions as ``rows`` of them need. All sequential
    operators stay on this partitioning, so a task's memory does not grow with the input.
    Joins keep it only if it has no fewer partitions than the session's shuffles."""
    if not many(rows):
        return events
    return events.repartition(max(-(-rows // TASK_EVENTS), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "subject_id")


def ordered(events: DataFrame, *by: str) -> DataFrame:
    """Events with pos, their place in the subject's history from 0, by time (nulls
    first) and then ``by``: every later operator orders by pos alone."""
    return events.withColumn("pos", F.row_number().over(W.partitionBy("subject_id").orderBy(F.asc_nulls_first("time"), *by)).cast("long") - 1)


def size(spark: SparkSession, sf_dir: str) -> int:
    """The number of events; it stands in the files' footers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def meds(spark: SparkSession, sf_dir: str, deal: bool = False, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """subject_id, event_id, time, t_us, code, numeric_value, pos. ``dealt`` where timelines are
    made of them, after what ``first`` adds to each event; counts by code read them as they lie."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.selectExpr("user_id as subject_id", "cast(ts as timestamp) as time", "event_id", "event_type", "value", f"{K} as k")
    rows = rows.selectExpr("subject_id", "event_id", "time", "unix_micros(time) as t_us", f"{CODE} as code", f"{VALUE} as numeric_value")
    rows = rows if first is None else first(rows)
    return ordered(dealt(rows, size(spark, sf_dir)) if deal else rows, "event_id")


def meds_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as events: many share a time."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = orders.selectExpr("o_custkey as subject_id", "cast(o_orderdate as timestamp) as time", "o_orderkey as k1", "0 as k2", "'HOSPITAL_ADMISSION' as code", "cast(null as double) as numeric_value")
    b = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    b = b.selectExpr("o_custkey as subject_id", "cast(l_shipdate as timestamp) as time", "l_orderkey as k1", "cast(l_linenumber as int) as k2", "concat('LAB//', cast(l_partkey % 20 as string), '//U') as code", "cast(l_quantity as double) as numeric_value")
    return ordered(a.unionByName(b).withColumn("t_us", F.unix_micros("time")), "k1", "k2", "code")


def splits(subjects: DataFrame) -> DataFrame:
    """subject_id and split: eight in ten train, one tuning, one held_out."""
    n = F.col("subject_id") % 10
    return subjects.select("subject_id").distinct().withColumn("split", F.when(n < 8, "train").when(n == 8, "tuning").otherwise("held_out"))


def of_split(events: DataFrame, table: DataFrame, split: str) -> DataFrame:
    """Events of the subjects of a split; val and test are other names for two."""
    name = {"val": "tuning", "test": "held_out"}.get(split, split)
    if table.where(F.col("split") == name).isEmpty():
        raise ValueError(f"no subjects in the split {split}")
    return events.join(table.where(F.col("split") == name).select("subject_id"), "subject_id", "left_semi")


def sample_subjects(subjects: DataFrame, n: int, seed: int) -> DataFrame:
    """n subjects by the order of a seeded hash, the same in every run."""
    return subjects.select("subject_id").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), "subject_id").cast("binary")), "subject_id").limit(n)


def listed(text: str, spark: SparkSession) -> DataFrame:
    """subject_id of a written list of ids, "1,2,3"."""
    return spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", ",")).alias("s")).where(F.trim("s") != "").select(F.trim("s").cast("long").alias("subject_id")).distinct()


def chosen(subjects: DataFrame, n: int, strategy: str = "random", seed: int = 0) -> DataFrame:
    """n subjects: the first by id, or a seeded sample."""
    if strategy == "first":
        return subjects.select("subject_id").distinct().orderBy("subject_id").limit(n)
    if strategy != "random":
        raise ValueError(f"unknown strategy {strategy}")
    return sample_subjects(subjects, n, seed)
