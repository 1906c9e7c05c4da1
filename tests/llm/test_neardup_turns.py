"""Links between rows that are no pivots, where no pivot is close to any row."""

from pyspark.sql import functions as F

from plumbline.llm import neardup
from plumbline.llm.common import written


def test_the_last_turn_runs_though_no_pivot_is_close(spark):
    common = [f"w{i}" for i in range(40)]
    texts = [" ".join(common), " ".join([*common, "end"])]
    texts += [" ".join(common + [f"p{k}x{i}" for i in range(40 * 2**k)]) for k in range(8)]  # none within 80 % of another
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    features = neardup.signatures(docs, 2).withColumn("bands", F.slice("bands", 1, 1))
    features = written(features, "features")
    one = features.orderBy("doc_id").first().bands[0]
    nodes = features.select("node", "doc_id", "n", F.array(F.lit(one)).alias("bands"), "sketch")
    for turn in range(neardup.PIVOTS):
        assert nodes.orderBy(F.xxhash64("node", F.lit(turn))).first().doc_id > 1  # a pivot that is close to nothing
    labels = neardup.link(nodes, docs, 2, 80)
    comp = {r.doc_id: r.comp for r in nodes.join(labels, "node").collect()}
    assert comp[0] == comp[1]
