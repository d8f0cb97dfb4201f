"""A small shell: ``python -m docspark.shell FOLDER`` reads statements from standard input."""

from __future__ import annotations

import json
import sys

from .database import Database
from .language.lexer import ParseError
from .plans.values import AnalysisError

HELP = "A statement, or: open FOLDER, show collections, pretty, run FILE, version, help, quit"


class Shell:
    def __init__(self, spark: object, path: str | None = None, out: object = sys.stdout, limit: int = 1000):
        self.spark, self.out, self.limit, self.pretty = spark, out, limit, False
        self.db = Database(spark, path)

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def line(self, text: str) -> bool:
        """Run one line; false to end."""
        text = text.strip()
        word, _, rest = text.partition(" ")
        match word.lower():
            case "":
                pass
            case "quit" | "exit":
                return False
            case "help":
                self.say(HELP)
            case "version":
                self.say(f"Spark {self.spark.version}")
            case "pretty":
                self.pretty = not self.pretty
            case "open":
                self.db = Database(self.spark, rest.strip())
            case "close":
                self.db = Database(self.spark)
            case "show" if rest.strip().lower() == "collections":
                for n in self.db.collection_names():
                    self.say(n)
            case "run":
                with open(rest.strip()) as f:
                    return all(self.line(x) for x in f.read().split(";\n"))
            case _:
                try:
                    rows = self.db.execute(text).limit(self.limit).collect()
                    for r in rows:
                        self.say(json.dumps(r.asDict(True), default=str, ensure_ascii=False, indent=2 if self.pretty else None))
                except (ParseError, AnalysisError, KeyError, ValueError) as e:
                    self.say(f"ERROR: {e}")
        return True


def main() -> None:
    from pyspark.sql import SparkSession

    shell = Shell(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else None)
    for text in sys.stdin:
        if not shell.line(text):
            break


if __name__ == "__main__":
    main()
