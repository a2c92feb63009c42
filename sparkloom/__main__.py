"""Command line: a novel file to cards, a book and a report.

    python -m sparkloom --input book.epub --name Title --base-url URL --api-key KEY --model MODEL [--out DIR]

The ledger of replies is kept beside the output, so a second call asks only for blocks that are not done.
"""

from __future__ import annotations

import argparse
from functools import partial

from .operators.extract import ClientConfig, HttpClient
from .plans import novel
from .session import session
from .sources.readers import read_novels


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description="A novel to the cards of its main characters and one shared book.")
    p.add_argument("--input", required=True, help="a .txt or .epub file")
    p.add_argument("--name", required=True, help="title, which names cards and book")
    for c in ("--base-url", "--api-key", "--model"):
        p.add_argument(c, required=True)
    p.add_argument("--max-characters", type=int, default=5, help="cards of the most mentioned characters")
    p.add_argument("--max-blocks", type=int, default=0, help="blocks to ask about; 0 for all")
    p.add_argument("--chunk-chars", type=int, default=3000)
    p.add_argument("--out", default="dist/novel")
    p.add_argument("--master", default=None, help="Spark master; the cluster's own by default")
    return p


def client(config: ClientConfig) -> HttpClient:
    return HttpClient(config)


def main(args: list[str] | None = None, factory=None) -> None:
    a = parser().parse_args(args)
    factory = factory or partial(client, ClientConfig(a.base_url, a.api_key, a.model))
    spark = session("sparkloom-novel", a.master)
    text = read_novels(spark, a.input).first()["text"]  # one book, which one task packs anyway
    print(f"{a.input}: {len(text)} characters")
    done = novel.distill(spark, text, a.name, factory, f"{a.out.rstrip('/')}/{a.name}.ledger", a.max_characters, a.max_blocks, a.chunk_chars)
    novel.write(done, a.out, a.name)
    for r in done.cards.select("name", "mentions").collect():  # as many as there are cards
        print(f"card {r['name']}: {r['mentions']} mentions")
    print(f"{a.out}/{a.name}: cards, worldbook, report")


if __name__ == "__main__":
    main()
