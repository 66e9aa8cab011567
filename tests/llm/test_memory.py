"""What operators leave to Python workers: batches of few bytes, and nothing of another operator."""

import re

import pyarrow as pa

from halyard.llm import common, jaccard, mixing, substring, toxicity


def test_texts_reach_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    df = spark.range(0, 64, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 100000) as text")
    assert jaccard.near_duplicates(df).count() == 64

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    sizes = [r.n for r in df.mapInArrow(held, "n long").collect()]
    assert sum(sizes) > 20e6
    assert max(sizes) < 2 * common.BATCH_BYTES
    spark.conf.set(key, "5000000")  # the session's own bound stays
    assert jaccard.near_duplicates(df).count() == 64
    assert spark.conf.get(key) == "5000000"
    spark.conf.unset(key)


def test_a_task_drops_what_another_operator_keeps():
    dropped = []
    common.keep("one", lambda: dropped.append("one"))
    batch = pa.RecordBatch.from_pydict({"n": [1]})
    assert list(common.tidy(lambda bs: bs, "one")(iter([batch]))) == [batch]
    assert not dropped
    assert list(common.tidy(lambda bs: bs)(iter([batch]))) == [batch]
    assert dropped == ["one"]


def test_joins_have_one_long_as_key(spark, monkeypatch):
    plans = []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, name)

    monkeypatch.setattr(jaccard, "written", recorded)
    groups = spark.range(0, 240, 1, 2).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', i, '_', cast(id / 40 as int))), concat('x', id % 40)) as text")
    found = jaccard.near_duplicates(groups)
    assert {r.component_id for r in found.collect()} == {0, 40, 80, 120, 160, 200}
    keys = [k for p in plans for k in re.findall(r"(?:BroadcastHash|SortMerge|ShuffledHash)Join \[([^\]]*)\]", p)]
    assert len(keys) > 10
    assert not [k for k in keys if "," in k]


def test_lists_of_the_driver_start_no_python_worker(spark, monkeypatch):
    given = []
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(data) or make(self, data, *a, **b))
    docs = spark.createDataFrame(pa.table({"doc_id": list(range(90)), "text": [f"badword{i % 3}x some words here" if i % 3 < 1 else f"clean{i} text of words" for i in range(90)], "source": ["a", "b", None] * 30}))
    labels = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 1, 0) as toxic")
    toxicity.fit(docs, labels)
    assert mixing.mix(docs).count() == 90
    assert mixing.mixed_documents(docs).count() > 0
    assert len(given) >= 4
    assert all(isinstance(x, pa.Table) or len(x) == 0 for x in given)


def _python_functions(plan, others):
    """How many Python functions the last stage of a plan runs in one task; those of the stages before go to others."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _python_functions(plan.initialPlan(), others)
    children = plan.children()
    below = [_python_functions(children.apply(i), others) for i in range(children.size())]
    if "Exchange" in name:
        others += below
        return 0
    return (max(below) if name == "Union" else sum(below)) + ("Arrow" in name or "Pandas" in name)


def test_a_stage_takes_one_worker_a_task(spark, monkeypatch):
    counts = []

    def counted(df):
        counts.append(_python_functions(df._jdf.queryExecution().executedPlan(), counts))

    def recorded(df, name):
        counted(df)
        return common.written(df, name)

    for module in (jaccard, substring, mixing):
        monkeypatch.setattr(module, "written", recorded)
    passage = " ".join([f"p{i}" for i in range(20)])
    docs = spark.createDataFrame(pa.table({"doc_id": list(range(60)), "text": [f"a{i} b{i} {passage if i % 3 else ''} c{i} d{i}" for i in range(60)], "source": ["a", "b"] * 30}))
    found = substring.dedup(docs, keep=("doc_id",))
    counted(found)
    assert {r.doc_id for r in found.collect() if r.n_removed} == {i for i in range(60) if i % 3 and i > 1}
    counted(jaccard.representatives(docs))
    counted(mixing.mixed_documents(docs))
    assert len(counts) > 20 and max(counts) == 1
