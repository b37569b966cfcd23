import random

import pytest

from pulsegrid.operators import evaluate
from pulsegrid.plans import text
from pulsegrid.plans.queries import oscillator_report
from pulsegrid.sources import drift
from pulsegrid.sync import s3, store


def test_reports(spark, sf):
    shown = text.summary(oscillator_report(spark, sf).first())
    assert "136 frames" in shown and "0.853" in shown and "latency 0.90 s" in shown
    shown = text.drift(evaluate.drift_tally(drift.drift_features(spark)).collect())
    assert "176/360" in shown and shown.count("4/360") == 2
    assert text.share(float("nan")) == "n/a" and text.seconds(None) == "none"


def test_an_outage_ends():
    now = [0.0]
    inner = store.MemoryUploader()
    up = store.OutageUploader(inner, 1.0, 2.0, rng=random.Random(1), clock=lambda: now[0])
    for t, works in ((10.0, True), (11.0, False), (12.9, False), (13.0, True)):
        now[0] = t
        if works:
            up.upload(str(t), b"")
        else:
            with pytest.raises(store.TransientUploadError):
                up.upload(str(t), b"")
    assert len(inner.objects) == 2


class Refused(Exception):
    def __init__(self, status):
        self.response = {"ResponseMetadata": {"HTTPStatusCode": status}}


def test_object_storage_failures():
    class Connection:
        def put_object(self, **kw):
            raise Refused(kw["Key"] and int(kw["Key"]))

    up = s3.S3Uploader(s3.S3Config("b"), Connection())
    for status, kind in ((503, store.TransientUploadError), (429, store.TransientUploadError), (403, store.PermanentUploadError)):
        with pytest.raises(kind):
            up.upload(str(status), b"")
    assert s3.kind_of(ConnectionError()) is store.TransientUploadError and s3.kind_of(ValueError()) is store.PermanentUploadError
