"""Templates of many segments: a sample meets the amplitudes of its own segment only."""

from pyspark.sql import functions as F

from tessera.operators import templates as B


def test_amplitudes_are_packed_by_segment(spark):
    samples = spark.createDataFrame([(d, s) for d in range(2) for s in range(100)] + [(3, 10**9)], "det long, samp long")
    basis = B.polynomial(F.when(F.col("samp") % 64 < 48, F.floor(F.col("samp") / 16)), (F.col("samp") % 16) / 8.0 - 1, 0, 2, 1 << 16)
    for of in (basis, B.MaskedBasis(F.col("det") < 5, basis), B.KroneckerBasis(basis, B.harmonic_basis(F.col("samp"), 1, constant=True))):
        template = B.Template(of, samples)
        known = template.reached()
        width = of.size // (1 << 16)
        assert known.groupBy("det").count().where("det < 2").agg(F.max("count")).first()[0] == 6 * width  # not all of 65,536 segments
        assert {r.det for r in known.select("det").distinct().collect()} == {0, 1}
        values = known.withColumn("v", F.col("det") + F.col("b") % 7 + 1.0)
        amplitudes = {(r.det, r.b): r.v for r in values.collect()}
        design = {(r.det, r.samp): r.d for r in samples.select("det", "samp", of.design().alias("d")).collect()}
        out = template(values).collect()
        assert len(out) == 201 and set(template(values).columns) == {"det", "samp", "v"}
        for r in out:
            assert abs(r.v - sum(c.x * amplitudes[r.det, c.b] for c in design[r.det, r.samp])) < 1e-9
