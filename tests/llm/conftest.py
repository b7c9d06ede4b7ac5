import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Rows that every operator on texts must stand: nulls, emptiness, long and repeated texts, odd spaces and letters.
ODD = [
    (1, None), (2, ""), (3, " \n\t  "), (4, "one"), (5, "one two three"), (6, "A b\tC  d\n\n e"), (7, "ab " * 9000),
    (8, "  lead and trail  "), (9, "Größe ÉCOLE ΣΑΣ naïve — “quoted” 数据 数据 😀 é  x y\x1cz"),
    (10, "don't we'll I'M x_y 12 345 ½ ² foo.bar!!! ¿que?"), (11, "same words here " * 20), (12, "same words here " * 20),
    (13, "tail \n"), (14, "a  b   c    d \n \n e \t\nf"), (15, "x" * 5000), (16, "é" * 700),
]


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, docs_schema):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs_schema)


@pytest.fixture(scope="session")
def empty_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)


@pytest.fixture(scope="session")
def rows_of():
    def rows(df, *columns):
        return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)

    return rows
