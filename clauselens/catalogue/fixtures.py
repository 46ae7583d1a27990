"""Inputs of the registered queries, derived from the given tables.

The given prose holds no legal words, so every document gets clauses of a small
bank by ``doc_id % 8``.  ``catalogue.sql`` builds the same inputs in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens import schemas
from clauselens.functions.text import strip
from clauselens.operators.rules import default_rules

GROUPS = 8

# Keywords tried in the simulation: they replace those of the rules named in it.
OVERRIDE = "gdpr compliance, meter, indemnity"

# One preamble per group, put before the text.
PREAMBLES = (
    'THIS LEASE is made between RAVI KUMAR S/O Mohan Kumar, hereinafter called the "Landlord". '
    'and PRIYA NAIR D/O Arun Nair, hereinafter referred to as the Tenant) WHEREAS the parties agree.',
    "Offer Letter — NORTHWIND TRADING LTD for the year.\nDear Maria Lopez, we offer you the "
    "position of Data Analyst, starting on 23 Jun 2025 at Rs. 50,000/- per month.",
    "The supply contract between: Alpha Works of Pune, and Beta Stores of Goa NOW THEREFORE they agree.",
    "This agreement is governed by the laws of the State of New York, dated January 15, 2026.",
    "Dear Omar Haddad, your fee is USD 5,000.50 and EUR 1,200 thousand, due 04-Aug-2025.",
    "The courts of Delhi NCR shall have exclusive jurisdiction. Fees are ₹12,50,000 lakh.",
    "Laws of Kerala shall govern this deed, made on the 10th day of August, 2025 for $900.",
    "Subject to the laws of Goa, executed 04/08/2025; the exclusive jurisdiction of the courts at Panaji, India.",
)

# (group, clause), put after the text in this order.
CLAUSES = (
    (0, "12. The Tenant shall indemnify and hold harmless the Landlord against all claims, losses and expenses arising from its use of the premises."),
    (0, "The Tenant shall indemnify and hold harmless the Landlord against all claims, losses and costs arising from its use of the premises."),
    (0, "The annual rent shall increase by 10% every year, see Sec. 14(2) of the Act."),
    (0, "Either side may end the deal with 30 days written notice; a fee of Rs. 2,500.50 applies."),
    (0, "The default setting of the heater shall stay unless an administrator changes it."),
    (1, "Either side may terminate this engagement by letter, or at once with salary in\nlieu of notice."),
    (1, "During the probation period of six months the employer reviews your performance."),
    (1, "All inventions and work product belong to the employer as intellectual property."),
    (1, "You shall not solicit any client of the business for twelve months after leaving."),
    (1, "All employees have access to the office premises during normal business hours."),
    (2, "The maximum liability of the Supplier shall not exceed the fees paid; consequential damages are excluded."),
    (2, "Liability for indirect loss is limited to the aggregate fees. Nothing else is owed."),
    (2, "Neither party is liable for delay caused by force majeure or an act of god."),
    (2, "This contract renews automatically for a further period unless written notice is given."),
    (2, "Confidential information and each trade secret must stay with the recipient."),
    (3, "The Landlord may inspect the premises at reasonable hours after a reasonable notice."),
    (3, "The Tenant shall vacate the premises and handover possession within 15 days."),
    (3, "If the Tenant does not vacate, summary eviction follows, e.g. by an order of the court."),
    (3, "The security deposit is non-refundable and the Landlord may deduct repair costs."),
    (3, "A late fee of Rs. 500 per day is due on overdue rent, i.e. after the fifth day."),
    (4, "All disputes shall be referred to a sole arbitrator in Delhi under binding arbitration."),
    (4, "The arbitrator met the parties once."),
    (4, "The parties submit to the exclusive jurisdiction of the courts of Mumbai."),
    (4, "Governing law: this deed is construed under the laws of India."),
    (4, "A force majeure event that delays performance must be reported."),
    (5, "The Tenant shall not sublet or assign or transfer the premises without written consent."),
    (5, "Subletting or assignment is void unless the Landlord gives permission."),
    (5, "Structural repairs are carried out by the owner, wear and tear by the tenant."),
    (5, "The tenant keeps the garden in good state and bears the cost of every repair."),
    (5, "Electricity charges, water charges and utility bills are paid by the occupant; the meter is read monthly."),
    (6, "The Employee agrees to a non-compete covenant and shall not engage in a competing business."),
    (6, "This agreement will auto-renew every year. A notice period of two months applies before it expires."),
    (6, "The Vendor complies with the General Data Protection Regulation (GDPR) and keeps audit logs of personal data."),
    (6, "Payment is due on delivery!\n\nUtilities are included: water, light and heat."),
    (6, "The Agent shall defend the Owner and indemnify and keep indemnified its staff vs. third parties."),
    (7, "Delayed payment attracts default interest at 2.5 percent per month."),
    (7, "The escalation clause lets the rate of rent rise with the index each year."),
    (7, "Right of entry: the lessor may enter upon the premises for inspection."),
    (7, "Trade secrets, non-disclosure and an NDA bind the recipient of such information."),
    (7, "On resignation the employee serves a notice period; dismissal is immediate for cause."),
)

# Rules besides the seeds: category, level, threshold, weight, description, keywords, active.
PROBE_RULES = (
    ("Licensing", "Low", 0.60, 0.4, "Mentions of licences.", "licen, released under", True),
    ("Renting", "Medium", None, 0.6, None, "rent", True),
    ("GDPR Compliance", "High", 0.85, 1.1, "Personal data duties.", "gdpr, data protection , personal data,", True),
    ("Security Deposit", "Low", 0.0, 0.3, "", "deposit", True),
    ("Indemnity Cap", "High", 0.85, 1.5, "Needs strong evidence.", None, True),
    ("audit logs", "Low", 0.70, 0.2, "No definition applies.", None, True),
    ("Switched Off", "High", 0.10, 9.0, "Inactive rule.", "the, rent", False),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, least: int = 1) -> DataFrame:
    """A table of texts, spread out when its files give fewer tasks than ``least`` for each core.

    Text work is what costs here, and a small file is one task.  With many
    files or row groups the condition is false and nothing is shuffled.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least * cores else df.repartition(2 * least * cores)


def group_texts():
    """Closing text of every group."""
    return ["\n".join(c for g, c in CLAUSES if g == i) for i in range(GROUPS)]


def _pick(texts, number):
    return F.get(F.lit(list(texts)), F.pmod(number, F.lit(len(texts))).cast("int"))


def contracts(spark: SparkSession, sf: str, least: int = 1) -> DataFrame:
    """documents as one-page contracts."""
    return texts(spark, sf, "documents", least).select(
        "doc_id", F.lit(1).alias("page_number"),
        F.concat(
            _pick(PREAMBLES, F.col("doc_id")), F.lit("\n"), F.col("text"), F.lit("\n"),
            _pick(group_texts(), F.col("doc_id"))).alias("text"))


def contract_pages(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as documents of several pages."""
    return as_contract_pages(texts(spark, sf, "conversations"))


def as_contract_pages(conversations: DataFrame) -> DataFrame:
    """Turns as pages, each with a clause of the bank: documents start at
    different places of the bank and go on every second page."""
    bank = [c for _, c in CLAUSES]
    pick = F.col("conv_id") + F.floor(F.col("turn") / 2)
    return conversations.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"),
        F.concat("text", F.lit("\n\n"), _pick(bank, pick)).alias("text"))


def rules(spark: SparkSession) -> DataFrame:
    seeds = default_rules(spark)
    rows = [(100 + i, *r) for i, r in enumerate(PROBE_RULES)]
    return seeds.unionByName(spark.createDataFrame(rows, schemas.RULES))


def tenant_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule table per customer: category names built from the customer's key."""
    from clauselens import fixed_values as fv

    names = [s[0] for s in fv.RULE_SEEDS]
    variants = (
        lambda n: n, lambda n: F.upper(n), lambda n: F.concat(F.lit("  "), n, F.lit(" ")),
        lambda n: F.concat(F.lit("Old "), n), lambda n: F.concat(n, F.lit(" & auto-increase")),
        lambda n: F.concat(F.col("c_mktsegment"), F.lit(" rules")),
    )
    base = _pick(names, F.col("c_custkey"))
    kind = F.pmod(F.col("c_custkey"), F.lit(len(variants)))
    name = F.lit("")
    for i, make in enumerate(variants):
        name = F.when(kind == i, make(base)).otherwise(name)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("rule_id"), name.alias("category"),
        F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")),
                     (F.pmod(F.col("c_custkey"), F.lit(3)) + 1).cast("int")).alias("default_risk_level"),
        F.lit(0.7).alias("confidence_threshold"), F.lit(1.0).alias("weight"),
        F.col("c_name").alias("description"),
        F.concat(F.col("c_mktsegment"), F.lit(", Rent ,,"), F.col("c_name")).alias("keywords"),
        (F.pmod(F.col("c_custkey"), F.lit(7)) != 0).alias("is_active"))


def many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule per customer that looks for words of the document of the same number.

    Some categories are null or blank, some ids stand twice, a tenth has a definition.
    """
    from clauselens import fixed_values as fv

    key = F.col("c_custkey")
    words = F.split("text", " ")
    seed = _pick([s[0] for s in fv.RULE_SEEDS], key)
    name = (
        F.when(key % 300 == 1, F.lit(None)).when(key % 300 == 2, F.lit(""))
        .when(key % 20 == 3, seed).when(key % 20 == 4, F.concat(F.lit("  "), F.upper(seed)))
        .otherwise(F.coalesce(F.concat(F.get(words, F.lit(5)), F.lit(" "), F.get(words, F.lit(6))),
                              F.concat("c_mktsegment", F.lit(" rules"))))
    )
    keywords = F.concat_ws(
        ",", F.when(key % 5 == 0, F.get(words, F.lit(1))),
        F.concat(F.lit(" "), F.get(words, F.lit(2)), F.lit(" "), F.get(words, F.lit(3))),
        F.when(key % 50 == 0, F.lit("Rent")), F.col("c_name"))
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return table(spark, sf, "customer").join(documents, F.col("doc_id") == key, "left").select(
        (key - (key % 100 == 1).cast("int")).cast("int").alias("rule_id"), name.alias("category"),
        F.lit("Low").alias("default_risk_level"), F.lit(0.7).alias("confidence_threshold"),
        F.lit(1.0).alias("weight"), F.col("c_name").alias("description"), keywords.alias("keywords"),
        (key % 7 != 0).alias("is_active"))


def model_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a pretended model, with doubles and an unknown category."""
    named = F.array_compact(F.array(
        F.when(F.col("toxic") == 1, "Indemnity"), F.when(F.col("toxic") == 1, "Indemnity"),
        F.when(F.col("quality") == 1, "Arbitration"), F.lit("No Such Category")))
    return table(spark, sf, "labels").select(
        "doc_id", F.lit(0).alias("chunk_index"), F.explode(named).alias("category"))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """documents as uploaded files."""
    i = F.col("doc_id")
    kinds = ("pdf", "DOCX", "doc", "txt")
    states = ("completed", "pending", "processing", "failed")
    size = F.when(F.pmod(i, F.lit(50)) == 0, 0) \
        .when(F.pmod(i, F.lit(97)) == 0, 60 * 1024 * 1024).otherwise(F.col("n_chars"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("user_id"),
        F.concat(F.lit("doc_"), i.cast("string"), F.lit("."), _pick(kinds, i)).alias("original_filename"),
        F.upper(_pick(kinds, i)).alias("file_type"), size.cast("long").alias("file_size_bytes"),
        _pick(states, i).alias("status"),
        F.when(F.pmod(i, F.lit(4)) == 3, "broken file").alias("error_message"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))")
        .alias("uploaded_at"), "text")


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Owners of the uploads and some customers without documents."""
    owners = table(spark, sf, "documents").select(F.col("source").alias("user_id")).distinct()
    others = table(spark, sf, "customer").select(F.col("c_name").alias("user_id"))
    n = F.length("user_id") + F.ascii(F.right("user_id", F.lit(1)))
    return owners.union(others).select(
        "user_id", F.concat("user_id", F.lit("@example.org")).alias("email"),
        F.concat(F.lit("User "), "user_id").alias("full_name"),
        F.when(F.pmod(n, F.lit(5)) == 0, "admin").otherwise("user").alias("role"),
        (F.pmod(n, F.lit(3)) != 0).alias("is_active"),
        F.expr("timestamp_ntz'2023-06-01 00:00:00' + make_dt_interval(0, ascii(right(user_id, 1)), 0)")
        .alias("created_at"))


def blocks(pages: DataFrame) -> DataFrame:
    """Lines of pages as text blocks: 12 units apart, 40 more every 5 lines."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("line", "text")
    y0 = F.col("line") * 12.0 + F.floor(F.col("line") / 5) * 40.0
    return (
        pages.select("doc_id", "page_number", line)
        .filter(strip(F.col("text")) != "")
        .select(
            "doc_id", "page_number", F.lit(50.0).alias("x0"), y0.alias("y0"),
            (F.lit(50.0) + F.length("text")).alias("x1"), (y0 + 10.0).alias("y1"), "text")
    )


NOISE_LINES = (
    "04Q55120987765401239abc", "Szz0H rreDF", "eSigned using Aadhaar OTP", "Date: Mon Jan 12 2024",
    "oe br Pe ae cecitet", "x 12 his /", "ee", "Pay %500 on the 10\" day", "all érsons named",
    "7<« clause", "ee Mrs. Rao", "e NOW it is agreed", "   ", "", "", "", "a plain line  ",
)


def noisy_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents with scanner noise put between their lines."""
    noise = F.lit(list(NOISE_LINES))
    n = len(NOISE_LINES)
    lines = F.split("text", "\n", -1)
    mixed = F.transform(
        lines,
        lambda x, i: F.concat(x, F.lit("\n"), F.get(noise, F.pmod(i + F.col("doc_id"), F.lit(n)).cast("int"))))
    return texts(spark, sf, "documents").select("doc_id", F.array_join(mixed, "\n").alias("text"))


