"""The data model bound to the driver's star-schema tables: deterministic and made of integers only."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.scratch import parts, stored

BASE_DAY = "1995-01-01"
WEEKS = [2, 4, 6, 8, 10, 12, 14, 16]
MODELS = [1, 2, 3]
#: Lines of orders that meet in one task, about.
LINES = 400_000
#: Customers up to which Spark may broadcast them: about 200 bytes each in a join by enrolment, of which files show few.
CUSTOMERS = 50_000


class Binding:
    """The tables of the data model over the star-schema files in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, query: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(query, **tables)

    def parts(self, name: str, each: int) -> int | None:
        return parts(self.read(name), each)

    @cached_property
    def many(self) -> bool:
        """Whether enrolments are too many to be broadcast."""
        return self.read("customer").count() > CUSTOMERS

    def info(self) -> DataFrame:
        """studentInfo: one row per enrolment."""
        return self.sql(
            """SELECT c_custkey AS id_student, c_mktsegment AS code_module, r_name AS code_presentation,
              CASE c_custkey % 5 WHEN 0 THEN 'Withdrawn' WHEN 1 THEN 'Fail' WHEN 2 THEN 'Pass' WHEN 3 THEN 'Distinction' ELSE 'Other' END AS final_result,
              CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, n_name AS region,
              element_at(array('No Formal quals', 'Lower Than A Level', 'A Level or Equivalent', 'HE Qualification', 'Post Graduate Qualification', 'Unknown'), cast(c_custkey % 6 + 1 AS int)) AS highest_education,
              CASE c_custkey % 4 WHEN 0 THEN '0-10%' WHEN 1 THEN '10-20' WHEN 2 THEN '90-100%' END AS imd_band,
              CASE c_custkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band,
              CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS disability,
              cast(c_custkey % 3 AS int) AS num_of_prev_attempts, cast(30 * (c_custkey % 5 + 1) AS int) AS studied_credits
            FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
            customer=self.read("customer"), nation=self.read("nation"), region=self.read("region"),
        )

    def registration(self) -> DataFrame:
        """studentRegistration."""
        info = self.info().select("id_student", "code_module", "code_presentation")
        day = (F.col("id_student") * 37) % 160 - 60
        leave = day + 20 + (F.col("id_student") * 13) % 120
        return info.withColumn("date_registration", F.when(F.col("id_student") % 29 != 0, day).cast("int")).withColumn("date_unregistration", F.when(F.col("id_student") % 5 == 0, leave).cast("int"))

    def labels(self) -> DataFrame:
        """KEY and label: 1 for a balance of 3000 and more."""
        balance = self.read("customer").select(F.col("c_custkey").alias("id_student"), (F.col("c_acctbal") >= 3000).cast("int").alias("label"))
        return self.info().select("id_student", "code_module", "code_presentation").join(balance.hint("merge") if self.many else balance, "id_student")

    def lines(self) -> DataFrame:
        """Order lines with their orders and the orders' enrolments, dealt by enrolment to tasks of about LINES lines."""
        n = self.parts("lineitem", LINES)
        dealt = lambda df, key: df.repartition(n, key).hint("merge") if n else df
        lines = dealt(self.read("lineitem"), "l_orderkey").join(dealt(self.read("orders"), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        info = self.info().select("id_student", "code_module", "code_presentation")
        return dealt(lines, "o_custkey").join(dealt(info, "id_student"), F.col("o_custkey") == F.col("id_student"))

    def vle_events(self) -> DataFrame:
        """studentVle: an order line is an interaction with its part."""
        return self.lines().select("id_student", F.col("l_partkey").alias("id_site"), F.datediff(F.to_date("o_orderdate"), F.lit(BASE_DAY)).alias("date"), F.col("l_quantity").cast("long").alias("sum_click"), "code_module", "code_presentation")

    def sites(self) -> DataFrame:
        """vle: every 17th site has no activity type."""
        kind = F.when(F.col("p_partkey") % 17 != 0, F.concat(F.lit("t"), F.col("p_size") % 5))
        return self.read("part").select(F.col("p_partkey").alias("id_site"), kind.alias("activity_type"))

    def site_weeks(self) -> DataFrame:
        """vle metadata by presentation: weeks in which a site is meant to be used."""
        info = self.info().groupBy("code_module", "code_presentation").agg(F.min("id_student").alias("m"))
        return info.select("code_module", "code_presentation", (F.col("m") % 3).cast("double").alias("week_from"), (F.col("m") % 3 + 10).cast("double").alias("week_to"))

    def presentations(self) -> DataFrame:
        """The presentations and their number in order of their names."""
        names = self.info().select("code_module", "code_presentation").distinct()
        return self.sql("SELECT code_module, code_presentation, dense_rank() OVER (ORDER BY code_module, code_presentation) - 1 AS nth FROM {names}", names=names)

    def assessments(self) -> DataFrame:
        """Eight per presentation; the last has no due day."""
        each = self.presentations().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
        return each.select((F.col("nth") * 8 + F.col("k")).cast("long").alias("id_assessment"), "code_module", "code_presentation", F.when(F.col("k") < 7, 14 * (F.col("k") + 1)).alias("date"), (5 * (F.col("k") + 1)).alias("weight"))

    def submissions(self) -> DataFrame:
        """studentAssessment: an order line is a submission."""
        mine = self.lines().join(F.broadcast(self.presentations()), ["code_module", "code_presentation"])
        return mine.select(
            (F.col("nth") * 8 + F.col("l_suppkey") % 8).cast("long").alias("id_assessment"), "id_student", F.datediff(F.to_date("l_shipdate"), F.lit(BASE_DAY)).alias("date_submitted"),
            ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).cast("int").alias("is_banked"),
            F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") * 1000).cast("long")).alias("score"),
        )

    def kdd_enrolments(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("enrollment_id"), F.col("c_mktsegment").alias("course_id"))

    def kdd_truth(self) -> DataFrame:
        """Every third enrolment has no known outcome."""
        return self.kdd_enrolments().where("enrollment_id % 3 != 0").select("enrollment_id", (F.col("enrollment_id") % 2).cast("int").alias("dropout"))

    def kdd_logs(self) -> DataFrame:
        return self.read("events").select(F.col("user_id").alias("enrollment_id"), F.col("ts").alias("time"), F.col("event_type").alias("source"), F.col("event_type").alias("event"))

    def kdd_dates(self) -> DataFrame:
        """Courses start on 2024-01-01 and last five weeks; one has no dates."""
        courses = self.kdd_enrolments().select("course_id").distinct()
        known = F.col("course_id") != "MACHINERY"
        return courses.select("course_id", F.when(known, F.to_date(F.lit("2024-01-01"))).alias("from"), F.when(known, F.to_date(F.lit("2024-02-03"))).alias("to"))


class Until(Binding):
    """The tables of another binding with the interactions and submissions of days 0 to `day`, without it. Both are taken from
    the order lines once and stored: the operators of one query read them up to seven times, and each time all lines
    would be dealt and sorted anew for the few of those days."""

    def __init__(self, b: Binding, day: int):
        super().__init__(b.spark, b.dir)
        within = lambda c: (F.col(c) >= 0) & (F.col(c) < day)
        self._events = stored(b.vle_events().where(within("date")), "interactions")
        self._submissions = stored(b.submissions().where(within("date_submitted")), "submissions")

    def vle_events(self) -> DataFrame:
        return self._events

    def submissions(self) -> DataFrame:
        return self._submissions
