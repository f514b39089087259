"""``python -m gridreach smoke|mazes|run FOLDER``: record a campaign in a folder and write its summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import campaign
from .sources import campaigns, recipes


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridreach")
    p.add_argument("command", choices=["smoke", "mazes", "run"], help="a small grid; mazes; or all recipes of --recipes over the maps below --maps")
    p.add_argument("folder")
    p.add_argument("--preset", default="smoke")
    p.add_argument("--methods", default="", help="names joined by commas, instead of the preset's")
    p.add_argument("--sweep", default="default")
    p.add_argument("--recipes", default="")
    p.add_argument("--maps", default="")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("gridreach").getOrCreate()
    config = campaign.preset(a.preset)
    if a.methods:
        config = campaign.replace(config, methods=tuple(campaign.method_names(a.methods)))
    if a.command == "smoke":
        maps = [campaign.smoke_map(spark)]
    elif a.command == "mazes":
        maps = [campaign.maze_map(spark, 5, 5, extra) for extra in (0, 4)]
    else:
        maps = [campaign.recipe_map(spark, a.maps, recipes.recipe_of(r)) for r in recipes.load(spark, a.recipes).collect()]
    about = {"campaign_id": a.command, "spark": spark.version, "master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism}
    campaigns.describe(spark, a.folder, about, {"pair_seed": hex(config.pair_seed), "query_count": config.queries, "correctness_check_count": config.checks})
    for m in maps:
        for variant in campaign.sweep(config, a.sweep):
            campaign.record(spark, a.folder, m, variant, a.command)
    print(campaigns.summary(spark, a.folder, about))


if __name__ == "__main__":
    main()
