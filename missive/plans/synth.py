"""Messages derived from orders, customers and parts, by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: template k of order key modulo 24; {s} the subject, {d} the due date, {o} a code
TEMPLATES = [
    "Would you draft the {s} before {d}?", "Kindly file the {s} by {d}.", "I need you to repaint the {s} by {d}.", "Remember to weigh the {s}; deadline is {d}.",
    "Calendar invite: {s}, {d} at 14:00, Pier 3.", "The {s} rehearsal is scheduled for {d} at 9:30 in Hut 4.", "Reminder: {s} tasting happens on {d} at 09:30 in the orchard.",
    "Can you share an update on draft the {s}?", "Any progress on the item concerning the {s}?", "Follow-up: any update on the {s}?", "Update: draft the {s} has been completed.", "The {s} has been cancelled.",
    "The {s} has been moved to {d} at 11:00.", "The date for {s} stays the same, but the time is now 15:45.", "The deadline to repaint the {s} is now {d}, quite urgent.", "The deadline to repaint the {s} is now tomorrow at 10 AM.",
    "The {s} might already be done, but I am not completely sure.", "The deadline may be Tuesday, or it may be Thursday.", "Your OTP is {o}. It expires in 5 minutes.", "From noon you can contact me on 70155 28643.",
    "The login details are with the harbour master.", "Half price on {s} this week. Use code SAVE30.", "For my profile, I prefer letters to calls.", "The {s} is back in service.",
]


#: a text with a value, the same masked, and the types found, by order key; {o} a code, {c} a customer's name. First one of
#: each detector, then overlaps that precedence or length settles, then texts that only look alike
SECRETS = [
    ("Your verification code is {o}, tell nobody.", "Your verification code is ******, tell nobody.", "one_time_password"), ("The password is fern{o}.", "The password is ******.", "password"),
    ("My PIN is 48{o4}, {c}.", "My PIN is ******, {c}.", "password"), ("Credit card number 4012 8888 8888 {o4} for {c}", "Credit card number ****** for {c}", "payment_card"),
    ("My bank account number is AC{o}.", "My bank account number is ******.", "bank_account"), ("Use the access token dew{o} today", "Use the access token ****** today", "auth_token"),
    ("We found ghp_dew{o} in a log", "We found ****** in a log", "auth_token"), ("The backup code is moss{o}!", "The backup code is ******!", "account_recovery_code"),
    ("{c} has passport number P{o}.", "{c} has passport number ******.", "government_id"), ("The diagnosis shows a sprain of {c}. Rest helps.", "The diagnosis shows ******. Rest helps.", "health_information"),
    ("My home address is {o4} Elm Row. Come by.", "My home address is ******. Come by.", "postal_address"), ("Please deliver it to {o4} Quay Street today.", "Please deliver it to ******.", "postal_address"),
    ("From noon you can contact me on 70155 {o5}.", "From noon you can contact me on ******.", "phone_number"), ("{c} will send the login details.", "{c} will send the login details.", "credential_mention"),
    ("The diagnosis shows password fern{o}", "The diagnosis shows password ******", "password"), ("My home address is Elm Row, call me on 70155 {o5}.", "My home address is ******.", "postal_address"),
    ("The api key is sk_dew{o}.", "The api key is ******.", "auth_token"), ("Ship it to {o4} Quay Street, phone number 70155 {o5}.", "Ship it to ******.", "postal_address"),
    ("The OTP is {o} and the password is fern{o}.", "The OTP is ****** and the password is ******.", "one_time_password,password"), ("My address is Elm Row. Call me on 70155 {o5}.", "My address is ******. Call me on ******.", "postal_address,phone_number"),
    ("Spinning yarn: lot {o} went to {c}.", "Spinning yarn: lot {o} went to {c}.", ""), ("{c} compared 4012 {o4} and left", "{c} compared 4012 {o4} and left", ""), ("The shipment of {o} pans passed all tests.", "The shipment of {o} pans passed all tests.", ""),
]


#: orders whose messages one task makes, at most about
ROWS_A_TASK = 50_000


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def message_sql() -> str:
    """The message as a SQL CASE over k; runs in both engines."""
    cases = " ".join(f"WHEN {k} THEN replace(replace(replace({_quoted(t)}, '{{s}}', subj), '{{d}}', due), '{{o}}', code)" for k, t in enumerate(TEMPLATES))
    return f"CASE WHEN k IN (0, 4) AND o_orderkey % 5 = 0 THEN 'FYI: ' ELSE '' END || CASE k {cases} END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, timestamp, sender, message, batch_idx, batch_name, batch_kind, tenant and k of each order."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "part")}
    n_parts = t["part"].count()
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate").join(t["customer"].select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    orders = orders.withColumn("_part", F.col("o_orderkey") % n_parts).join(t["part"].select(F.col("p_partkey").alias("_part"), F.col("p_name").alias("subj")), "_part")
    # dealt by their keys before there is any text: to all cores at least, and to as many tasks as keep one small whatever the table's size
    tasks = max(spark.sparkContext.defaultParallelism, -(-t["orders"].count() // ROWS_A_TASK))
    orders = orders.repartition(tasks, "o_orderkey")
    rows = orders.withColumns(
        {
            "k": (F.col("o_orderkey") % 24).cast("int"),
            "due": F.date_format(F.date_add("o_orderdate", (F.col("o_orderkey") % 15).cast("int")), "yyyy-MM-dd"),
            "code": (F.col("o_orderkey") + 100000).cast("string"),
            "message_id": F.concat(F.lit("MSG_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")),
            "timestamp": F.date_format(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 86400).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss"),
            "batch_idx": F.year("o_orderdate") - 1995,
        }
    )
    sender = F.when(F.col("k") == 21, "Promotions").when(F.col("o_orderkey") % 7 == 0, "Project Lead").otherwise(F.col("c_name"))
    rows = rows.withColumns({"message": F.expr(message_sql()), "sender": sender, "batch_name": F.concat(F.lit("batch_"), F.col("batch_idx").cast("string")), "batch_kind": F.when(F.col("batch_idx") == 0, "l1").otherwise("l2"), "tenant": F.lit("")})
    return rows.select("message_id", "timestamp", "sender", "message", "batch_idx", "batch_name", "batch_kind", "tenant", "k")


def sql() -> str:
    """The same as the WITH entries ``messages`` and ``masked`` of a DuckDB query.

    In these templates the only secrets are the code of template 18 and the number of 19.
    """
    return f"""
        src AS (
            SELECT o_orderkey, c_name, p_name AS subj, CAST(o_orderkey % 24 AS INTEGER) AS k, strftime(o_orderdate + to_days(CAST(o_orderkey % 15 AS INTEGER)), '%Y-%m-%d') AS due,
                   CAST(o_orderkey + 100000 AS VARCHAR) AS code, 'MSG_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS message_id,
                   strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(year(o_orderdate) - 1995 AS INTEGER) AS batch_idx
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
        ), messages AS (
            SELECT message_id, timestamp, batch_idx, k, {message_sql()} AS message,
                   CASE WHEN k = 21 THEN 'Promotions' WHEN o_orderkey % 7 = 0 THEN 'Project Lead' ELSE c_name END AS sender
            FROM src
        ), masked AS (
            SELECT *, regexp_replace(regexp_replace(message, '(OTP is )[0-9]+', '\\1******'), '(contact me on )[0-9 ]*[0-9]', '\\1******') AS masked_text,
                   CASE k WHEN 18 THEN 'one_time_password' WHEN 19 THEN 'phone_number' WHEN 20 THEN 'credential_mention' END AS primary_type,
                   CASE k WHEN 18 THEN 'blocked' WHEN 19 THEN 'confirm_required' ELSE 'local_only' END AS route,
                   row_number() OVER (ORDER BY batch_idx, timestamp, message_id) AS seq,
                   regexp_replace(regexp_replace(message, '(OTP is )[0-9]+', '\\1******'), '^FYI: ', '') AS body0
            FROM messages
        ), bodies AS (
            SELECT *, regexp_replace(body0, '(contact me on )[0-9 ]*[0-9]', '\\1******') AS body FROM masked
        )
    """


def _filled_sql(column: int) -> str:
    """SQL of both engines: a column of SECRETS by order key, with its values."""
    cases = " ".join(f"WHEN {k} THEN {_quoted(row[column])}" for k, row in enumerate(SECRETS))
    text = f"CASE CAST(o_orderkey % {len(SECRETS)} AS INTEGER) {cases} END"
    values = {"{o}": "CAST(o_orderkey + 100000 AS STRING)", "{o4}": "CAST(o_orderkey % 9000 + 1000 AS STRING)", "{o5}": "CAST(o_orderkey % 90000 + 10000 AS STRING)", "{c}": "translate(c_name, '#0123456789', '-abcdefghij')"}
    for mark, value in values.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, message): a text of SECRETS for each order."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer")}
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").cast("string").alias("message_id"), F.expr(_filled_sql(0)).alias("message"))


def secrets_sql() -> str:
    """What must be found in ``secrets``: from the texts as they were made, without any pattern."""
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS message_id, {_filled_sql(1)} AS masked_text, {_filled_sql(2)} AS types FROM orders JOIN customer ON o_custkey = c_custkey"
