import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from pagelayout.functions.workers import per_worker
from pagelayout.operators import text
from pagelayout.sources import analyser, remote


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if "/broken" in self.path:
                self.send_error(500)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"path": self.path, "size": len(body), "type": self.headers["Content-Type"]}).encode())

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_multipart_body(spark):
    body = spark.createDataFrame([(bytearray(b"\x00\xff"), "a.JPEG")], "image binary, name string").select(remote.multipart(F.col("image"), F.col("name"), "B")).first()[0]
    assert bytes(body) == b'--B\r\nContent-Disposition: form-data; name="image"; filename="a.JPEG"\r\nContent-Type: image/jpeg\r\n\r\n\x00\xff\r\n--B--\r\n'


def test_requests_are_answered_or_have_an_error(spark, server):
    rows = spark.createDataFrame([(1, "/page"), (2, "/broken"), (3, "/ocr_page_stream")], "page_id long, path string")
    asked = rows.select("page_id", F.concat(F.lit(server), "path").alias("url"), remote.multipart(F.lit(b"x"), F.lit("p.png")).alias("request"))
    found = {r.page_id: r for r in remote.posted(asked, timeout=10).collect()}
    assert "request" not in remote.posted(asked).columns
    answer = json.loads(found[1].answer)
    assert answer["path"] == "/page" and answer["type"] == f"multipart/form-data; boundary={remote.BOUNDARY}"
    assert answer["size"] == len(asked.where("page_id = 1").first().request)
    assert found[1].error is None and found[2].answer is None and "500" in found[2].error


def test_stream_tickets_need_both_fields(spark):
    answers = spark.createDataFrame([(1, '{"stream_url": "u", "token": "t"}'), (2, '{"stream_url": "u", "token": ""}'), (3, '{"token": "t"}'), (4, "no"), (5, None)], "n long, answer string")
    rows = remote.stream_tickets(answers).orderBy("n").collect()
    assert [(r.stream_url, r.token, r.missing) for r in rows] == [("u", "t", False)] + [(None, None, True)] * 4
    assert remote.stream_tickets(answers.where("n = 1"), strict=True).first().token == "t"
    with pytest.raises(Exception, match="without stream_url or token"):
        remote.stream_tickets(answers, strict=True).collect()


def test_addresses_leave_out_an_empty_language(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "lang string")
    rows = [r[0] for r in df.select(remote.page_address("http://s/", F.lit(800), F.lit(1.5), F.col("lang"), F.lit(True), F.lit("x"))).collect()]
    short = "http://s/page?page_width=800&zoom_factor=1.5&bin=true&toc_algorithm=x"
    assert rows == [short + "&lang=a+b", short, short]


def test_a_worker_loads_once(spark):
    def load():
        import uuid

        return uuid.uuid4().hex

    get = per_worker(load)

    def run(batches):
        for b in batches:
            b["who"] = get() + get()
            yield b

    rows = [r.who for r in spark.range(100).repartition(8).mapInPandas(run, "id long, who string").collect()]
    assert all(x[:32] == x[32:] for x in rows) and len(set(rows)) <= 8


def test_settings_are_saved_and_read(spark):
    df = spark.createDataFrame([(3, "en"), (4, None)], "page int, lang string")
    rows = df.select(analyser.settings_text(F.struct("page", "lang")).alias("t")).select("t", analyser.settings(F.col("t"), "page int, lang string").alias("s")).collect()
    assert [(r.t, tuple(r.s)) for r in rows] == [('{"page":3,"lang":"en"}', (3, "en")), ('{"page":4}', (4, None))]


def test_crops_keep_an_area(spark):
    boxes = spark.createDataFrame([(-5, -5, 10, 10), (95, 0, 120, 10), (100, 0, 120, 10)], "x1 int, y1 int, x2 int, y2 int")
    assert sorted(tuple(r) for r in text.clamped_crops(boxes, 100, 100).collect()) == [(0, 0, 10, 10), (95, 0, 100, 10)]
