import os
import subprocess
import sys
import textwrap

import pytest

from tallyframe.llm import common

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_get_the_package_whatever_frame_an_operator_is_called_on(tmp_path):
    """From another folder, without PYTHONPATH and with frames that were never read from a table."""
    script = f"""
        import sys
        sys.path.insert(0, {HOME!r})
        from pyspark.sql import SparkSession
        from tallyframe.llm import byte_bpe, exact_dedup, kneser_ney, ngram_join, packing, pii, quality, warc
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        docs = spark.createDataFrame([(k, f"some text {{k}} mail a{{k}}@b.com") for k in range(8)], "doc_id long, text string")
        pages = spark.createDataFrame([(1, "http://a.b/", "x" * 200), (2, "http://a.b/2", "x" * 200)], "page_id long, url string, html string")
        marks = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
        runs = dict(
            pii=lambda: pii.spans(docs), masked=lambda: pii.redacted(docs), dedup=lambda: exact_dedup.groups(docs), near=lambda: ngram_join.components_of(docs),
            warc=lambda: warc.round_trip(pages), bpe=lambda: byte_bpe.digests(docs), back=lambda: byte_bpe.decode(byte_bpe.encode(docs)), pack=lambda: packing.pack(docs),
            model=lambda: kneser_ney.score(docs, kneser_ney.train(docs, 3)), quality=lambda: quality.accepted(docs, marks), scored=lambda: quality.scored(docs, quality.train(docs, marks)))
        print("COUNTS", {{name: run().count() for name, run in runs.items() if name == sys.argv[1] or sys.argv[1] == "all"}})
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != HOME)
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script), "all"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "COUNTS" in done.stdout, done.stderr[-3000:]
    counts = eval(done.stdout.split("COUNTS", 1)[1])
    assert counts.pop("warc") == 2 and counts.pop("quality") <= 8 and set(counts.values()) == {8}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class Context:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Context

    class Session:
        sparkContext = Elsewhere()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
    assert common.shared_dir(spark)
