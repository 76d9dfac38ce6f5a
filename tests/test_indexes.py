import os
import shutil

from strandline import schemas
from strandline.operators import embedding
from strandline.operators.store import Store
from strandline.plans import indexes


def fill(spark, root, name, count, width=8):
    index = Store(spark, f"{root}/{name}")
    embed = embedding.offline(width)
    rows = spark.range(count).selectExpr(f"concat('{name}-', id) as chunk_id", f"'{name}' as file_id", f"concat('/{name}/', id, '.txt') as file_path", "'txt' as file_type", "0 as chunk_index", "1 as total_chunks", f"concat('text ', id, ' of {name} cats') as content", "cast(null as array<int>) as page_numbers", "'text' as content_type", "cast(null as binary) as image_data").cache()
    changes = index.begin()
    changes.append("chunks", rows)
    changes.append("embeddings", rows.select("chunk_id", embed(rows.content).alias("vector")))
    changes.set_metadata(dimension=str(width), folder_path=f"/{name}")
    index.commit(changes)
    return rows


def test_several_indexes_and_broken_ones(spark, tmp_path):
    root, embed = str(tmp_path / "indexes"), embedding.offline(8)
    assert indexes.list_indexes(spark, root).count() == 0
    everything = [fill(spark, root, name, n) for name, n in (("one", 30), ("two", 12), ("three", 1))]
    fill(spark, root, "wide", 3, 16)
    fill(spark, root, "torn", 3)
    with open(f"{root}/torn/log/000000000002.json", "w") as torn:
        torn.write('{"version": 2, "tab')
    fill(spark, root, "lost", 5)
    shutil.rmtree(f"{root}/lost/embeddings")
    os.makedirs(f"{root}/not an index")
    rows = {r.index_name: r for r in indexes.list_indexes(spark, root).collect()}
    assert {n: (r.folder_path, r.chunks) for n, r in rows.items() if r.error is None} == {"one": ("/one", 30), "two": ("/two", 12), "three": ("/three", 1), "wide": ("/wide", 3), "lost": ("/lost", 5)}
    assert rows["torn"].error and rows["torn"].chunks is None

    found = indexes.search_indexes(spark, root, "text 3 of two cats", 6, embed, 8).collect()
    errors = {r.index_name: r.error for r in found if r.error}
    assert set(errors) == {"wide", "torn", "lost"} and "vectors of 16 values" in errors["wide"]
    together = everything[0].unionByName(everything[1]).unionByName(everything[2])
    single = indexes.search.semantic(together, together.select("chunk_id", embed(together.content).alias("vector")), embed(indexes.F.lit("text 3 of two cats")), 6)
    assert [(r.chunk_id, round(r.distance, 6)) for r in found if not r.error] == [(r.chunk_id, round(r.distance, 6)) for r in single.collect()]
    words = indexes.search_indexes(spark, root, "cats", 3, embed, 8, "keyword", only=["two", "three"]).collect()
    assert len(words) == 3 and {r.index_name for r in words} <= {"two", "three"} and not any(r.error for r in words)
    assert schemas.TABLES.keys() == set(schemas.KEYS)
