import uuid

import numpy as np

from tidewalk.llm import decontaminate

from .common_rows import words


def test_partial_sums_do_not_grow_with_the_partitions(spark, monkeypatch, tmp_path):
    """Each partial sum is 9 MB whatever its task read, so 150 tasks of two rows must not send one each."""
    finder, sent = decontaminate._range_finder, str(tmp_path)

    def counted(*args):
        inner = finder(*args)

        def run(batches):
            for out in inner(batches):
                open(f"{sent}/{uuid.uuid4().hex}", "w").close()
                yield out

        return run

    monkeypatch.setattr(decontaminate, "_range_finder", counted)
    docs = spark.createDataFrame([(i, " ".join(words(i, 40))) for i in range(300)], "doc_id long, text string")
    basis = decontaminate.latent_space(docs.repartition(150)).basis
    assert 1 <= len(list(tmp_path.iterdir())) <= 2 * spark.sparkContext.defaultParallelism
    alone = decontaminate.latent_space(docs.coalesce(1)).basis  # every row is still summed
    like = lambda x: (x / np.linalg.norm(x)) @ (x / np.linalg.norm(x)).T
    some = np.flatnonzero(alone.any(1))
    assert (np.flatnonzero(basis.any(1)) == some).all()
    assert np.abs(like(basis[some]) - like(alone[some])).max() < 1e-3
