from collections import defaultdict

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, n string, mask string"


@pytest.fixture
def docs_of(spark):
    """documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", "y", "z", None) for i, t in rows], DOCS)

    return make


def groups_of(ids, links):
    """Smallest member of each id's component, by brute force."""
    at = defaultdict(set)
    for a, b in links:
        at[a].add(b)
        at[b].add(a)
    root = {}
    for i in sorted(ids):
        if i in root:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += at[x]
    return root
