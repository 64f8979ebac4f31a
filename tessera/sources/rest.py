"""Records from paged web services, as a Spark data source.

A service is described by how it asks for a page and how it reads one. Nothing
is asked for at planning; an executor follows the pages of its service, so
that a network is needed only there. ``fetch`` may be replaced, as in tests.
"""
from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[str, dict[str, str]], bytes]


def fetch(url: str, headers: dict[str, str], wait: float = 5.0, tries: int = 5) -> bytes:
    """The body at url; waits and asks again when told to slow down, and raises at once without permission."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code in (401, 403):
                raise PermissionError(f"{error.code} from {url}: a key is needed") from error
            if error.code != 429 or attempt == tries - 1:
                raise
            time.sleep(wait)
    raise RuntimeError(url)


@dataclass
class Service:
    """A paged service: its address and parameters, where a page has its records, and where the mark of the next page."""

    url: str
    records: str
    parameters: dict[str, str] = field(default_factory=dict)
    next_mark: str = ""
    next_parameter: str = ""
    first_mark: str = ""
    headers: dict[str, str] = field(default_factory=dict)


def at(page: dict, path: str):
    for name in path.split("."):
        page = page.get(name) if isinstance(page, dict) else None
    return page


#: Public services by source, each with the form of its pages.
SERVICES = {
    "clinicaltrials": Service("https://clinicaltrials.gov/api/v2/studies", "studies", {"pageSize": "1000"}, "nextPageToken", "pageToken"),
    "openalex": Service("https://api.openalex.org/works", "results", {"per-page": "200"}, "meta.next_cursor", "cursor", "*"),
    "sbir": Service("https://api.www.sbir.gov/public/api/awards", "", {}),
}


def pages(service: Service, limit: int, get: Fetch = fetch) -> Iterator[dict]:
    """At most ``limit`` records, page by page."""
    mark, given = service.first_mark, 0
    while True:
        asked = service.parameters | ({service.next_parameter: mark} if mark else {})
        page = json.loads(get(f"{service.url}?{urllib.parse.urlencode(asked)}", service.headers))
        found = (at(page, service.records) if service.records else page) or []
        for record in found[: limit - given]:
            yield record
        given += len(found)
        mark = at(page, service.next_mark) if service.next_mark else None
        if not mark or not found or given >= limit:
            return


def patent_filter(since: str, subclasses: list[str]) -> dict:
    """The search condition of patents since a date in one of some subclasses."""
    return {"_and": [{"_gte": {"patent_date": since}}, {"_or": [{"cpc_current.cpc_subclass_id": s} for s in subclasses]}]}


def scan(spark: SparkSession, service: Service, schema, limit: int, get: Fetch = fetch) -> DataFrame:
    """The records of a service in a schema: one task follows its pages, since each names the next."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting = []
            for record in pages(service, limit, get):
                waiting.append(json.dumps(record, ensure_ascii=False))
                if len(waiting) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(waiting)], names=["value"])
                    waiting = []
            yield pa.RecordBatch.from_arrays([pa.array(waiting, type=pa.string())], names=["value"])

    from pyspark.sql import functions as F

    lines = spark.range(1, numPartitions=1).mapInArrow(run, "value string")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def dropped_file(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """A file that somebody put there, or None; it is only ever read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
