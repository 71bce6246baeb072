"""An engine object: analyses by content, a bounded cache of ledgers, questions and maintenance."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from missive.operators import classify, extract, model, routing, sensitive
from missive.operators.assistant import Answer, Assistant
from missive.operators.questions import Questions
from missive.plans.ledger import Ledger
from missive.sources.csv import MAX_FILES, MAX_ROWS, read_messages, stacked


class Engine:
    """Keeps the ledgers of the last few analyses, found again by the content of their batches."""

    def __init__(self, spark: SparkSession, artifact: model.Artifact | None = None, most: int = 3):
        self.spark, self.artifact, self.most = spark, artifact, most
        self.ledgers: OrderedDict[str, Ledger] = OrderedDict()

    def analyze(self, batches: list[tuple[str, str]]) -> str:
        """Key of the ledger of named CSV batches, in their order."""
        if not 0 < len(batches) <= MAX_FILES:
            raise ValueError(f"give 1 to {MAX_FILES} batches")
        key = hashlib.sha256("".join(f"{n}\0{t}\0" for n, t in batches).encode()).hexdigest()[:24]
        if key not in self.ledgers:
            read = [(n, read_messages(self.spark, t)) for n, t in batches]
            for name, rows in read:
                if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
                    raise ValueError(f"a batch may hold {MAX_ROWS} rows, {name} has more")
            self.ledgers[key] = Ledger(stacked(read), self.artifact)
            while len(self.ledgers) > self.most:
                self.ledgers.popitem(last=False)[1].unpersist()
        self.ledgers.move_to_end(key)
        return key

    def ledger(self, key: str) -> Ledger:
        if key not in self.ledgers:
            raise KeyError("this analysis isn't kept any more; analyze the batches again")
        self.ledgers.move_to_end(key)
        return self.ledgers[key]

    def ask(self, key: str, question: str, confirmed: bool = False) -> Answer:
        return Assistant(self.ledger(key)).answer(question, confirmed)

    def ask_all(self, key: str, questions: DataFrame) -> Questions:
        """Answers to a table (question_id, question) in one plan; the caller calls ``unpersist`` when done."""
        return Questions(self.ledger(key), questions)

    def classify_one(self, message: str, sender: str = "") -> DataFrame:
        """One message's masked text, route, category and item."""
        row = self.spark.createDataFrame([("MSG_0001", None, sender, message)], "message_id string, timestamp string, sender string, message string")
        rows = classify.with_rules(routing.route(sensitive.masked(row)))
        if self.artifact is not None:
            rows = model.with_predictions(rows, self.artifact)
        return extract.with_items(classify.with_category(rows, self.artifact is not None))

    def policy(self) -> DataFrame:
        return routing.policy_table(self.spark)

    def forget(self, key: str) -> bool:
        led = self.ledgers.pop(key, None)
        if led is not None:
            led.unpersist()
        return led is not None

    def health(self) -> dict:
        return {"ledgers": len(self.ledgers), "model": self.artifact is not None, "spark": self.spark.version}
