"""Quiz questions, grades, attempts and the wrong-answer book. An attempt's JSON stays inside its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.arrays import rows_of
from askloom.functions.ranking import top_n
from askloom.functions.text import let, trim_controls
from askloom.schemas import ANSWERS_JSON, GRADES_JSON, QUESTIONS_JSON, QUIZ_JSON

# ---- fixed values ----
PASS_SCORE = 60
WRONG_BOOK = 50
MIN_QUESTIONS = 3
CORRECT_COMMENT = "答对了。"
WRONG_COMMENT = "正确答案是 "
COMMENT_END = "。"
# ---- end of fixed values ----


def source_no_to_chunk(quizzes: DataFrame) -> DataFrame:
    """Generated quizzes (quiz_id, quiz JSON, unit_ids) to one row per question with its source chunk ids.

    Source numbers count the units from 1; numbers out of range drop out. Fewer than three questions, or broken
    JSON, reject the quiz.
    """
    parsed = quizzes.withColumn("q", F.from_json("quiz", QUIZ_JSON)["questions"]).filter(F.coalesce(F.size("q"), F.lit(0)) >= MIN_QUESTIONS)
    asked = F.transform("q", lambda q: F.struct(
        F.coalesce(q["type"], F.lit("short")).alias("type"), q["stem"].alias("stem"), q["answer"].alias("answer")))
    sources = F.transform("q", lambda q: F.transform(
        F.filter(F.coalesce(q["sourceNos"], F.expr("cast(array() as array<int>)")), lambda n: (n >= 1) & (n <= F.size("unit_ids"))),
        lambda n: F.get(F.col("unit_ids"), n - 1)))
    return rows_of(parsed, F.arrays_zip(asked.alias("asked"), sources.alias("source_chunk_ids")), "quiz_id").select(
        "quiz_id", "pos", "item.asked.*", "item.source_chunk_ids")


def grade_choice(answers: DataFrame) -> DataFrame:
    """Grade choice questions (type, answer, explanation, user_answer): equal without case and outer blanks is 100."""
    given = F.lower(trim_controls(F.coalesce("user_answer", F.lit(""))))
    correct = (given != "") & (given == F.lower(trim_controls(F.coalesce("answer", F.lit("")))))
    comment = F.concat(F.when(correct, CORRECT_COMMENT).otherwise(F.concat(F.lit(WRONG_COMMENT), F.col("answer"), F.lit(COMMENT_END))),
                       F.coalesce("explanation", F.lit("")))
    return answers.filter(F.col("type") == "single").withColumn("correct", correct).withColumn(
        "score", F.when(correct, 100).otherwise(0)).withColumn("comment", comment)


def clamp_score(graded: DataFrame, score: str = "score") -> DataFrame:
    """Scores from outside held to 0..100."""
    return graded.withColumn(score, F.greatest(F.lit(0), F.least(F.lit(100), F.col(score))))


def typed(attempts: DataFrame) -> DataFrame:
    """The attempts with ``questions``, ``grades`` and ``answers`` as arrays: JSON text is parsed, once; arrays stay as they are. Every operator on attempts takes
    either form, so a typed table is never parsed again."""
    schemas = {"questions": QUESTIONS_JSON, "grades": GRADES_JSON, "answers": ANSWERS_JSON}
    texts = {c: F.from_json(c, s) for c, s in schemas.items() if c in attempts.columns and attempts.schema[c].dataType == T.StringType()}
    return attempts.withColumns(texts) if texts else attempts


def attempt_total(attempts: DataFrame) -> DataFrame:
    """Mean score of an attempt, cut to a whole number."""
    grades = F.from_json("grades", GRADES_JSON) if attempts.schema["grades"].dataType == T.StringType() else F.col("grades")
    mean = let(grades, lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x["score"]) / F.greatest(F.size(g), F.lit(1)))
    return attempts.withColumn("total_score", mean.cast("int"))


def attempt_summary(attempts: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` attempts per knowledge base and visitor with question and wrong counts. Only the newest are parsed."""
    newest = typed(top_n(attempts, ["kb_id", "visitor_id"], [F.desc("attempt_id")], n))
    return newest.withColumns({"question_count": F.size("questions"), "wrong_count": F.size(F.filter("grades", lambda g: g["score"] < PASS_SCORE))})


def wrong_book(attempts: DataFrame, limit: int = WRONG_BOOK) -> DataFrame:
    """Questions scored below the pass mark with options and missed sentences, newest attempts first, ``limit`` per knowledge base and visitor.

    Questions, grades and answers are zipped by position inside the row; the shortest list decides.
    """
    zipped = F.arrays_zip(F.col("questions").alias("q"), F.col("grades").alias("g"), F.col("answers").alias("a"))
    n = F.greatest(F.least(F.size("questions"), F.size("grades"), F.size("answers")), F.lit(0))
    wrong = F.filter(F.transform(F.slice(zipped, 1, n), lambda z, i: F.struct(i.alias("index"), z.alias("z"))), lambda x: x["z"]["g"]["score"] < PASS_SCORE)
    fields = {"question_index": "index", "type": "z.q.type", "stem": "z.q.stem", "options": "z.q.options", "answer": "z.q.answer", "explanation": "z.q.explanation",
              "score": "z.g.score", "comment": "z.g.comment", "missed_sentences": "z.g.missedSentences", "user_answer": "z.a"}
    rows = rows_of(typed(attempts), wrong, "kb_id", "visitor_id", "attempt_id", "created_at").select(
        "kb_id", "visitor_id", "attempt_id", "created_at", *[F.col(f"item.{f}").alias(name) for name, f in fields.items()])
    return top_n(rows, ["kb_id", "visitor_id"], [F.desc("attempt_id"), F.asc("question_index")], limit)


def mark_mastered(attempts: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the score of the named questions (attempt_id, question_index) to 100; indexes out of range change nothing. Grades come back in the form they had.

    Several updates of one attempt are gathered as a set of indexes, at most one per question.
    """
    marks = updates.groupBy("attempt_id").agg(F.collect_set("question_index").alias("_mastered"))
    as_text = attempts.schema["grades"].dataType == T.StringType()
    grades = F.transform(F.from_json("grades", GRADES_JSON) if as_text else F.col("grades"), lambda g, i: F.when(
        F.array_contains("_mastered", i), g.withField("score", F.lit(100))).otherwise(g))
    return attempts.join(marks, "attempt_id", "left").withColumn(
        "grades", F.when(F.col("_mastered").isNotNull(), F.to_json(grades) if as_text else grades).otherwise(F.col("grades"))).drop("_mastered")


def attempt_detail(attempts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found attempts, keys without one) for keys (attempt_id, kb_id, visitor_id)."""
    on = ["attempt_id", "kb_id", "visitor_id"]
    return attempts.join(keys.select(*on), on), keys.join(attempts.select(*on), on, "left_anti")


def edit_eval_set(questions: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining questions with their ``position`` per knowledge base, newest first from 1; deletes (q_id, kb_id) that match no question)."""
    on = ["q_id", "kb_id"]
    left = questions.join(deletes.select(*on), on, "left_anti")
    listed = left.withColumn("position", F.row_number().over(W.partitionBy("kb_id").orderBy(F.desc("q_id"))))
    return listed, deletes.join(questions.select(*on), on, "left_anti")
