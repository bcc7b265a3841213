"""The labelled url table that the classifier is fitted on: names made of topic words by rule, no site of any given table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

# Words that tell of unwanted sites, and words of ordinary ones.
UNWANTED = """casino poker jackpot roulette slots betting odds bonus wager lottery viagra pharmacy pills steroids adult porn xxx webcam escort
hookup payday loans debt replica counterfeit warez keygen serial cracked torrent spam backlinks clicks popunder adserver tracker banner
giveaway prize winner millionaire crypto-doubler weightloss miracle""".split()
ORDINARY = """news library university museum weather recipes school garden research history science health city council journal archive code docs
guide tutorial blog forum wiki travel music theatre sport nature birds kitchen bread books maps streets biology physics painting language
family school-board trails parks calendar lessons essays poems""".split()
_ENDS = ("example", "test", "invalid")
_PATHS = ("", "/", "/index.html", "/{a}", "/{a}/{b}", "/{b}/1", "/{b}-{a}.html")


def seed_rows() -> list[tuple[str, int]]:
    """(url, label) with label 1 for unwanted: each word with the next few of its list, in host and path."""
    out = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, a in enumerate(words):
            for step in (1, 2, 5, 11):
                b = words[(i + step) % len(words)]
                k = zlib.crc32(f"{a} {b}".encode())
                host = (f"{a}-{b}", f"{a}{b}", f"www.{a}.{b}", f"{b}.{a}")[k % 4]
                out.append((f"http://{host}.{_ENDS[k // 4 % 3]}{_PATHS[k // 16 % 7].format(a=a, b=b)}", label))
    return out


def is_held_out(url: str) -> bool:
    """Every fifth row by a hash is for tests of what the others teach."""
    return zlib.crc32(url.encode()) % 5 == 0


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r for r in seed_rows() if not is_held_out(r[0])], "url string, label int")
