"""Building a query runs no job of its own: only the reader's look at a table's footer. No plan joins
all rows with all rows."""

from civlens.plans import catalog

SF_SMALL = "/root/testdata/sf0.001"
#: Queries that fit a model, an index of categories or clusters while they are built.
FITTED = ("m01", "m06", "m11", "m13", "m14", "m15", "m16", "m17", "m18", "m19", "m21_forest", "sp16", "s18")


def test_building_runs_no_jobs(spark):
    catalog.load_all()
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    busy, crossing = {}, []
    for name, query in catalog.QUERIES.items():
        if name.startswith(FITTED):
            continue
        sc.setJobGroup(f"build-{name}", name)
        reads = []
        read = type(spark.read).parquet

        def counted(self, *paths, reads=reads, read=read, **options):
            reads.append(paths)
            return read(self, *paths, **options)

        type(spark.read).parquet = counted
        try:
            df = query(spark, SF_SMALL)
        finally:
            type(spark.read).parquet = read
        jobs = len(tracker.getJobIdsForGroup(f"build-{name}"))
        if jobs > len(reads):
            busy[name] = (jobs, len(reads))
        sc.setJobGroup(f"plan-{name}", name)
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
            crossing.append(name)
    sc.setJobGroup("tests", "tests")
    assert not busy and not crossing
