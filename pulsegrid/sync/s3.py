"""Object storage, where boto3 is installed. Everything else works without."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pulsegrid.sync.store import PermanentUploadError, TransientUploadError, failure

try:
    import boto3
    from botocore.exceptions import BotoCoreError, ClientError
except ImportError:
    boto3 = None


@dataclass(frozen=True)
class S3Config:
    bucket: str
    prefix: str = "telemetry/v1"
    region: str = "us-east-1"
    endpoint_url: str | None = None
    access_key: str | None = None
    secret_key: str | None = None


def client(config: S3Config):
    if boto3 is None:
        raise RuntimeError("boto3 is not installed")
    more = {"endpoint_url": config.endpoint_url, "aws_access_key_id": config.access_key, "aws_secret_access_key": config.secret_key}
    return boto3.client("s3", region_name=config.region, **{k: v for k, v in more.items() if v is not None})


def ensure_bucket(of, config: S3Config) -> None:
    """Makes the bucket unless it is there. The default region must not be named."""
    place = {} if config.region == "us-east-1" else {"CreateBucketConfiguration": {"LocationConstraint": config.region}}
    try:
        of.create_bucket(Bucket=config.bucket, **place)
    except ClientError as e:
        if e.response["Error"]["Code"] not in ("BucketAlreadyOwnedByYou", "BucketAlreadyExists"):
            raise


def listed(of, config: S3Config) -> Iterator[tuple[str, int]]:
    """(key, size) below the prefix, page by page."""
    for page in of.get_paginator("list_objects_v2").paginate(Bucket=config.bucket, Prefix=config.prefix):
        for entry in page.get("Contents", ()):
            yield entry["Key"], entry["Size"]


def fetched(of, config: S3Config, key: str) -> bytes:
    """A batch as it was stored, still compressed (see ``codec.deserialize``)."""
    return of.get_object(Bucket=config.bucket, Key=key)["Body"].read()


class S3Uploader:
    """Connects where it is used: a task gets the settings, not the connection."""

    def __init__(self, config: S3Config, connection=None) -> None:
        self.config, self.connection = config, connection

    def __getstate__(self) -> dict:
        return {"config": self.config, "connection": None}

    def upload(self, key: str, data: bytes) -> None:
        if self.connection is None:
            self.connection = client(self.config)
        try:
            self.connection.put_object(Bucket=self.config.bucket, Key=key, Body=data, ContentType="application/x-ndjson", ContentEncoding="gzip")
        except Exception as e:
            raise kind_of(e)(str(e)) from e


def kind_of(error: Exception) -> type[Exception]:
    """Which of the two failures an upload's exception is; anything without a status is a lost connection."""
    response = getattr(error, "response", None)
    if isinstance(response, dict):
        return failure(response.get("ResponseMetadata", {}).get("HTTPStatusCode")) or PermanentUploadError
    lost = (OSError, BotoCoreError) if boto3 else (OSError,)
    return TransientUploadError if isinstance(error, lost) else PermanentUploadError
