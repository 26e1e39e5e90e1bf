"""The near copies stage of the pipeline against all pairs of five-word shingles."""

import corpus_pipeline

from test_jaccard import corpus, shingles

SF = "/root/testdata/sf0.001"


def kept(rows):
    """Smallest ids of the groups that links of five-word similarity 0.8 or more make."""
    sets = [(i, shingles(t, 5)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in parent if root(i) == i}


def changed(name, at):
    return " ".join(("new" if i in at else "") + name + str(i) for i in range(200))


def test_five_words_and_eighty_percent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # 176 of 216 shingles in common: linked; 171 of 221: not
    odd = [(10_001, changed("a", ())), (10_002, changed("a", (20, 60, 100, 140)))]
    odd += [(20_001, changed("b", ())), (20_002, changed("b", (20, 60, 100, 140, 180)))]
    # short and long texts with few and many changes, lists of near misses
    more = [(30_000 + i, t) for i, t in corpus()]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in odd + more], docs.schema))
    got = [r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, SF).select("doc_id").collect()]
    want = kept([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {10_001, 20_001, 20_002} <= want and 10_002 not in want
    assert len(got) == len(set(got)) and set(got) == want
