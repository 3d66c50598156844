"""Vectors through JSON lines: none of their bits may be lost."""

import duckdb
import numpy as np
import pytest

from veclith.plans import catalog, operations

#: Little-endian floats with a rotated coordinate so close to a boundary that the doubles which
#: their shortest decimals stand for have another code.
CLOSE = [
    "97d9263d7483c93d0187a7bdd5024fbe6d1febbd57f0c73d56320b3dd89a923e97f0003edb15cf3c5916e1bdc18613be11643abe87430cbe9de9b4bc977013bef027d9bc16b089bd671962bd9ad658beeeb616bedf04653e311f3bbd0bc74fbe77928fbd5427b4b903c60e3e46350ebee658ce3d30fcf2bd33acb43d5e44923dec60813d4c2c653922f228beea251b3eae990e3ec4088d3d9f966cbe9d51b3bb417d4bbebb0e02be595d9cbbd399d53b49eb713e0c1f51be32bca4bdb7842c3e9ebc53bc886c093e530dc0bd45efcfbd5b5fa3bd9b14ce3d09779cbd0e56003c942726bddfabaebd10f03d3d9a43633eec965f3d4d8ba5bd0cfaf63d8e34583c",
    "0f82d1bd8d8b743deb63e23c2a10553d7a00733e0eac313d8d648ebc5d8c633c3bc6973d2042ccbead0e223cc88f7f3e11fa3b3e5ae44cbeb3e989bdadbd03be5b10103db68583bd38ad3fbe3e00b03c8f36b83dc3b8333e904892bd4e46503de2df8b3d527c0b3da863503e8ca372be51afbf3d99c4963cc788c13c3b17e1bdf22ca2bd0402da3cbbc0753e9050b53d025c4c3df3f1813dd64e5a3e9b1452beef3c4dbdbcdc2f3df28552bd04c7ccbd58dfe53b33de3fb9a8f1a4bb4dc5333d389f2dbef29134be385ae9ba254b863ec5a0e6bcfdbc943ca46191bd940823bd00c647bd490f89bca77d83bdede213be489cc4bc20bc4f3ca7ebe3bd729427be",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    x = np.concatenate([np.random.default_rng(5).standard_normal((50, catalog.DIM)).astype(np.float32), [np.frombuffer(bytes.fromhex(h), "<f4") for h in CLOSE]])
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["jsonl_export", "streaming_ingest"])
def test_codes_after_json_lines_match_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(operations.oracle_sql()[name]).df().sort_values("vec_id").reset_index(drop=True)
    got = operations.queries()[name](spark, folder).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert got[list(want)].equals(want)
