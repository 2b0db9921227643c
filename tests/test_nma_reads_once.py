"""An analysis reads its records once."""

from pyspark.sql import functions as F

from tidemark.operators import nma, records


def test_records_are_read_once(spark):
    n = F.col("id")
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    arm = F.element_at(F.array(*map(F.lit, "abc")), ((n + n % 2) % 3 + 1).cast("int"))
    ipd = spark.range(900).select(F.concat(F.lit("s"), (n % 4).cast("string")).alias("study_id"), arm.alias("arm"), n.alias("subject_id"), (n * 7 % 31).cast("double").alias("time"), (n % 3 > 0).cast("int").alias("event"))
    ipd = spark.createDataFrame(ipd.collect(), ipd.schema)
    out = nma.run_nma(ipd.mapInArrow(pass_on, ipd.schema))
    got = {r.treatment: r.hr for r in out["ranking"].collect()}
    rows = {name: sorted(map(tuple, out[name].collect())) for name in ("studies", "edges", "components")}
    assert seen.value == 900
    assert got == {r.treatment: r.hr for r in nma.cox_hr(ipd).collect()} and len(got) == 3
    assert rows["studies"] == sorted(map(tuple, records.study_summary(ipd).collect()))
    assert rows["edges"] == sorted(map(tuple, nma.treatment_edges(ipd).collect()))
    assert {c for _, c in rows["components"]} == {"a"}
