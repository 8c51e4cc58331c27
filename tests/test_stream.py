"""The stream: rejects that are taken back, units read by ranges of paths, archives."""

import io
import zipfile

from codecat.plans import catalogue as store
from codecat.plans import incremental
from codecat.streaming.reindex import kept_rejects, reindex, reindex_archives


def add(corpus, home, contents):
    corpus(contents).write.mode("append").parquet(f"{home}/corpus")


def run(spark, home):
    reindex(spark, f"{home}/corpus", f"{home}/catalogue", f"{home}/digests", f"{home}/checkpoint", rejects=f"{home}/rejects").awaitTermination()
    documents = sorted(r["name"] for r in store.open_catalogue(spark, f"{home}/catalogue").collect())
    return documents, sorted((r["path"], r["reason"]) for r in kept_rejects(spark, f"{home}/rejects").collect())


def test_rejects_are_taken_back(spark, corpus, tmp_path):
    home = str(tmp_path)
    add(corpus, home, {"/v/pyvenv.cfg": "", "/n/node_modules/q/sub/package.json": "{bad", "/g/go.mod": "none", "/java/sources/A.java": "class A", "/v/notes.txt": ""})
    missing = [("/g/go.mod", "no module name"), ("/java/sources/A.java", "no package"), ("/n/node_modules/q/sub/package.json", "bad manifest")]
    assert run(spark, home) == ([], sorted([*missing, ("/v/pyvenv.cfg", "no site-packages")]))
    add(corpus, home, {"/v/lib/site-packages/p/__init__.py": "", "/n/node_modules/q/package.json": '{"name":"q","version":"1"}', "/n/node_modules/q/x.js": ""})
    # The environment has packages now, and the outer manifest hides the bad one.
    assert run(spark, home) == (["p", "q/x.js"], missing[:2])
    assert run(spark, home) == (["p", "q/x.js"], missing[:2])


def test_batches_read_what_they_touch(spark, corpus, tmp_path, monkeypatch):
    """Stored facts of other units are skipped by ranges of paths, and many units give the same documents."""
    plans, own = [], incremental.staged

    def spied(df, label, *rest, **options):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return own(df, label, *rest, **options)

    monkeypatch.setattr(incremental, "staged", spied)
    for few in (100, 0):
        monkeypatch.setattr(incremental, "FEW_UNITS", few)
        home = str(tmp_path / str(few))
        for i in range(3):
            plans.clear()
            add(
                corpus,
                home,
                {
                    f"/v{i}/pyvenv.cfg": "", f"/v{i}/site-packages/p{i}/__init__.py": "", f"/n{i}/node_modules/q/package.json": '{"name":"q","version":"1"}',
                    f"/n{i}/node_modules/q/x{i}.js": "", f"/g{i}/x.go": "", f"/g{i - 1}/go.mod": f"module g{i - 1}",
                },
            )
            found, _ = run(spark, home)
        assert found == ["g0/x.go", "g1/x.go", "p0", "p1", "p2", "q/x0.js", "q/x1.js", "q/x2.js"]
        if few:
            for label, folder in (("python", "/v2/"), ("npm", "/n2/node_modules/")):
                plan = next(p for name, p in plans if name == label)
                assert f"GreaterThanOrEqual(path,{folder})" in plan and "/v1" not in plan


def test_archives_in_the_stream(spark, tmp_path):
    home = str(tmp_path)
    for i in (1, 2, 2):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            out.writestr("org/A.java", f"package org;\nclass A{i}")
        rows = [(f"/h/.m2/repository/org/lib/{i}/lib-{i}-sources.jar", bytearray(packed.getvalue())), (None, bytearray())]
        spark.createDataFrame(rows, "path string, content binary").write.mode("append").parquet(f"{home}/archives")
        reindex_archives(spark, f"{home}/archives", f"{home}/catalogue", f"{home}/state", f"{home}/checkpoint").awaitTermination()
    found = store.open_catalogue(spark, f"{home}/catalogue").select("name", "path").collect()
    assert sorted(map(tuple, found)) == [(f"org.A.A{i}", f"/java/sources/org/lib/{i}/org/A.java") for i in (1, 2)]
