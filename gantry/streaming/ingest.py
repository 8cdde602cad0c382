"""From a message source to the raw zone, the quarantine and the live summary.

    python -m gantry.streaming.ingest --root <folder> --checkpoints <folder> \\
        --option kafka.bootstrap.servers=<hosts> --option subscribe=<topic> --option maxOffsetsPerTrigger=<n>

`--merge` merges the folders of the summary and the totals instead, as a job to run now and then.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gantry.operators.events import PAYLOAD, parse_events, quarantine, validate_and_enrich
from gantry.session import build_session, prepare
from gantry.sources import files
from gantry.sources.readers import read_messages
from gantry.streaming.landing import DELAY, TRIGGER, land_all, merge_summary, merge_totals, start_ingest, wait_all


def ingest_messages(messages: DataFrame, root: str, checkpoints: str, interval: str | None = TRIGGER,
                    delay: str = DELAY) -> list[StreamingQuery]:
    """Start the landing of a stream of messages with a `value`; rejected rows keep the message's text.

    One query reads the source for all sinks. Checkpoints that three queries began (`start_ingest`)
    are gone on with by three, as the source's messages would otherwise be landed once more;
    `delay` is theirs only.
    """
    if not files.exists(messages.sparkSession, f"{checkpoints}/raw"):
        return [land_all(messages, root, f"{checkpoints}/all", interval)]
    parsed = parse_events(messages, keep=[PAYLOAD])
    return start_ingest(validate_and_enrich(parsed), quarantine(parsed), root, checkpoints, interval, delay)


def run(spark: SparkSession, source: str, options: Mapping[str, str], root: str, checkpoints: str,
        interval: str | None = TRIGGER, delay: str = DELAY) -> None:
    """Ingest until a query fails or, without an interval, until all that is there is read."""
    wait_all(ingest_messages(read_messages(prepare(spark), options, source), root, checkpoints, interval, delay))


def main(argv: Sequence[str] | None = None) -> None:
    arguments = argparse.ArgumentParser()
    arguments.add_argument("--root", required=True)
    arguments.add_argument("--checkpoints", default=None)
    arguments.add_argument("--source", default="kafka")
    arguments.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="of the source")
    arguments.add_argument("--interval", default=TRIGGER)
    arguments.add_argument("--once", action="store_true", help="read what is there and stop")
    arguments.add_argument("--delay", default=DELAY, help="how late rows may be for a live summary with state")
    arguments.add_argument("--merge", action="store_true", help="merge the summary's folders and stop")
    given = arguments.parse_args(argv)
    spark = build_session("gantry-ingest")
    if given.merge:
        merge_summary(spark, f"{given.root}/summary")
        merge_totals(spark, f"{given.root}/totals")
        return
    options = dict(option.split("=", 1) for option in given.option)
    checkpoints = given.checkpoints or f"{given.root}/checkpoints"
    run(spark, given.source, options, given.root, checkpoints, None if given.once else given.interval, given.delay)


if __name__ == "__main__":
    main()
