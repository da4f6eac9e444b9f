"""matchspark: two-sided job matching as Spark DataFrame jobs.

Every public function takes DataFrames and returns DataFrames; none creates a
session.  Functions that must cut lineage write a table below the folder named
by ``spark.checkpoint.dir`` (see ``plans.materialize``).
"""
