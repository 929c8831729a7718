import io
import zipfile

import numpy as np

from quire.operators import preview, sinks


def test_thumbnails_of_any_shape():
    for shape in ((1, 1), (2000, 1), (1, 2000), (100, 100), (3505, 2480), (481, 10)):
        small = preview.thumbnail(np.full(shape, 7, np.uint8))
        assert small.size and max(small.shape) <= preview.THUMBNAIL and (small == 7).all()


def test_packages_hold_their_pictures(spark):
    row = "doc_id string, para_seq int, kind string, question_no int, text string, column_break boolean, page_break boolean"
    rows = spark.createDataFrame([("a", 1, "text", 1, "t", False, False), ("a", 2, "image", 1, "", False, False), ("a", 3, "image", 2, "", True, False), ("b", 1, "image", 1, "", False, False)], row)
    picture = sinks.png(3, 4, 9)
    media = spark.createDataFrame([("a", "image2", bytearray(picture)), ("b", "image1", bytearray(picture))], "doc_id string, media_id string, content binary")
    files = {r["doc_id"]: zipfile.ZipFile(io.BytesIO(r["content"])) for r in sinks.hwpx_packages(rows, media).collect()}
    assert files["a"].read("BinData/image2.png") == picture and files["a"].read("BinData/image1.png") == files["a"].read("Preview/PrvImage.png") == sinks.png(8, 8)
    assert files["b"].read("Preview/PrvImage.png") == picture
    assert {r["doc_id"] for r in sinks.hwpx_packages(rows).collect()} == {"a", "b"}
