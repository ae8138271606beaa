"""Views in two arrivals give the facts of all views together."""

from packlens.functions import extract
from packlens.operators import fusion
from packlens.plans.queries import views
from packlens.streaming import views as stream


def test_two_arrivals(spark, sf, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    all_views = views(spark, sf).selectExpr("package_id", "cast(view_no as int) as view_no", "image_id", "file_name", "ocr_text")
    for part in ("view_no = 1", "view_no > 1"):
        all_views.where(part).write.mode("append").parquet(paths[0])
        stream.keep_declarations(stream.read_views(spark, paths[0]), paths[1], paths[2]).awaitTermination()
    columns = ["package_id", "key", "value", "evidence", "n_views"]
    got = stream.facts(spark, paths[1]).select(columns).collect()
    want = fusion.fuse(extract.declarations(all_views)).select(columns).collect()
    assert sorted(got) == sorted(want)
