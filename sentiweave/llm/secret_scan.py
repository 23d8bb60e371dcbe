"""Secret scans: candidate strings, and a random forest that removes false findings.

Candidates are long runs of key characters that a digit, a key's usual beginning or changes of
case set apart from a word, blocks of private keys, names and passwords in addresses, and
whatever of six characters or more is assigned to a secret word. The forest sees how a candidate
looks (length, kinds of characters and the transitions between them, what a dictionary
covers, whether it is a path) and which words stand before and behind it. It is trained
from labelled findings, a table that the caller may give; the default one is made here
from templates. Everything is Column code and MLlib.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters before and behind a candidate that its neighbouring words are taken from.
CONTEXT = 48
#: Findings score at least this.
THRESHOLD = 0.6
#: Bound on the labelled findings of each template; see :func:`labelled_findings`.
EXAMPLES = 150

#: Words that identifiers, paths and placeholders are made of.
DICTIONARY = (
    "about access account action admin album alpha application archive article asset author backup banner "
    "beta branch browser build button cache category chapter class client code color commit common company "
    "component config contact content context controller core count create customer dashboard data database "
    "debug default delete deploy design detail develop device directory document domain download draft dummy "
    "editor email error event example export factory feature field file filter final folder form format "
    "frame function gallery global group handler header helper history home html http image import index "
    "info input install interface internal invoice issue item java javascript language layout library license "
    "link list load local login main manager master message meta method mobile mode model module month name "
    "network news node number object order output page param parser path payment photo picture placeholder "
    "plugin post price private process product profile project public query record release report request "
    "resource response result review sample schema screen script search section server service session "
    "setting shop simple site source static status storage story style summary support system table target "
    "template test text theme thread time title tools topic tracking update upload user util value version "
    "video view week widget window world year your"
).split()

#: Words beside a secret, and words beside what only looks like one.
SECRET_WORDS = "passw|passphrase|pwd|secret|token|api|key|auth|credential|bearer|private|akia|login"
OTHER_WORDS = (
    "sha|md5|hash|commit|digest|checksum|etag|uuid|guid|revision|card|iban|phone|order|invoice|isbn|"
    "track|example|sample|dummy|placeholder|version|build|image|page|article|file|path|url|http|www"
)


#: What stands for a value.
NOTHING = "string undefined ******** required optional varchar changed invalid missing incorrect default ${password} <password> xxxxxxxx".split()
#: A value that directly follows a secret word and a sign, up to a blank or quote.
ASSIGNED = (
    r"(?<=[=:>]\s{0,3}[\"'`]?)(?<=(?i:" + SECRET_WORDS + r")[A-Za-z0-9_-]{0,12}[\"'`]?\s{0,3}(?::=|=>|[=:]{1,2})\s{0,3}[\"'`]?)"
    r"(?![=:>]|(?i:bearer|basic)\s)[^\s\"'`]{5,}[^\s\"'`,;.)\]}>]"
)
#: How the keys of well-known services begin.
KEY_STARTS = "AKIA|ASIA|AIza|gh[pousr]_|xox[abp]-|[sprS]k[-_]|eyJ|glpat-|npm_"
#: A block of a private key, to its end line if it has one.
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
#: A name and a password before the host of an address.
USER_INFO = r"(?<=://)[^\s/:@\"']{1,64}:[^\s/@\"']{3,128}(?=@)"
#: A run of key characters that no other joins: with a digit, all in capitals at its start, with
#: a key's beginning, or with two changes from small letters to capitals.
KEY_RUN = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Z+/_-]{16}|(?:" + KEY_STARTS + r")|[A-Z]*+[a-z]*+[A-Z]++[a-z]++[A-Z])"
    r"[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_-]))?"
)
CANDIDATE = f"{KEY_BLOCK}|{USER_INFO}|{ASSIGNED}|{KEY_RUN}"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features() -> dict[str, Column]:
    """Numbers of a row with candidate, before and behind (strings without null)."""
    c, before, behind = F.col("candidate"), F.lower("before"), F.lower("behind")
    size = F.length(c).cast("double")
    low = F.lower(c)
    covered = F.length(c) - F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))
    letters = F.array_distinct(F.split(c, ""))
    return {
        "length": size,
        "digits": _count(c, "[0-9]") / size,
        "capitals": _count(c, "[A-Z]") / size,
        "signs": _count(c, "[+/_=-]") / size,
        "other_signs": _count(c, "[^A-Za-z0-9+/_=-]") / size,
        "beyond_hex": _count(low, "[g-z]") / size,
        "different": F.size(letters) / size,
        "letter_to_digit": _count(c, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / size,
        "case_changes": _count(c, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / size,
        "vowel_changes": _count(low, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])") / size,
        "same_pairs": _count(c, r"(.)(?=\1)") / size,
        "dictionary": covered / size,
        "key_prefix": c.rlike(f"^({KEY_STARTS}|-----BEGIN)").cast("double"),
        "user_info": (before.endswith("://") & behind.startswith("@")).cast("double"),
        "uuid": c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "path": _count(c, "/"),
        "in_path": (before.rlike(r"[/\\.]$") | behind.rlike(r"^[/\\.]")).cast("double"),
        "assigned": before.rlike("[=:]\\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & behind.rlike("^[\"'`]")).cast("double"),
        "secret_word": before.rlike(f"({SECRET_WORDS})[a-z_ -]{{0,12}}\\W{{0,5}}$").cast("double"),
        "other_word": (before.rlike(f"({OTHER_WORDS})[a-z_ -]{{0,12}}\\W{{0,5}}$") | behind.rlike(f"^\\W{{0,3}}({OTHER_WORDS})")).cast("double"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, number, candidate, before and behind for every candidate of every text.

    Numbers count from 1 in the order of the text. Null and empty texts have none.
    """
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), 0)
    pieces = F.split("text", CANDIDATE, -1)
    # A neighbouring candidate is context, too, such as the name that a value is given to.
    beside = lambda i: F.when(i >= 0, F.coalesce(F.get("found", i), F.lit(""))).otherwise("")
    each = F.transform(
        F.col("found"),
        lambda c, i: F.struct(
            (i + 1).alias("number"),
            c.alias("candidate"),
            F.right(F.concat(beside(i - 1), F.get("pieces", i)), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(F.get("pieces", i + 1), beside(i + 1)), F.lit(CONTEXT)).alias("behind"),
        ),
    )
    return (
        docs.select("doc_id", found.alias("found"), "text")
        .where(F.size("found") > 0)
        .select("doc_id", "found", pieces.alias("pieces"))
        .select("doc_id", F.inline(each))
    )


def labelled_findings(spark: SparkSession, examples: int = EXAMPLES) -> DataFrame:
    """candidate, before, behind, secret (0/1): ``examples`` rows for each template."""
    digest = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string"), F.col("kind")), 256)
    base = F.translate(F.base64(F.unhex(digest)), "+/=", "-_")
    plain = F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "Q"))
    words = F.array(*map(F.lit, DICTIONARY))
    word = lambda n: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    size = 16 + F.pmod(F.xxhash64("id"), F.lit(25)).cast("int")
    capital = lambda n: F.initcap(word(n))
    letters = F.translate(base, "0123456789-_", "xKqZvBwTjRgH")
    short = 6 + F.pmod(F.xxhash64("id"), F.lit(10)).cast("int")
    either = 8 + F.pmod(F.xxhash64("id"), F.lit(25)).cast("int")
    # kind, secret, text before, candidate, text behind
    kinds = [
        ("password", 1, F.lit("and password="), F.substring(digest, F.lit(1), size), F.lit(" the")),
        ("password_base", 1, F.lit("db_password: '"), F.substring(base, F.lit(1), size), F.lit("'")),
        ("token", 1, F.lit('of token = "'), F.substring(digest, 1, 40), F.lit('" and')),
        ("secret_key", 1, F.lit("SECRET_KEY="), F.substring(base, F.lit(1), size), F.lit("\n")),
        ("api_key", 1, F.lit('"api_key": "'), F.substring(digest, 1, 32), F.lit('",')),
        ("bearer", 1, F.lit("Authorization: Bearer "), base, F.lit("\n")),
        ("cloud_key", 1, F.concat(word(1), F.lit(" ")), F.concat(F.lit("AKIA"), F.substring(plain, 1, 16)), F.concat(F.lit(" "), word(2))),
        ("hub_token", 1, F.concat(word(1), F.lit(" ")), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base, "[-_]", "x"), 1, 36)), F.lit(" ")),
        ("commit", 0, F.lit("commit "), F.substring(digest, 1, 40), F.lit(" fixes")),
        ("checksum", 0, F.lit("sha256: "), digest, F.lit(" ok")),
        ("md5", 0, F.lit("md5 hash of the file "), F.substring(digest, 1, 32), F.lit(" is")),
        ("digest_alone", 0, F.concat(word(1), F.lit(" ")), F.substring(digest, 1, 40), F.concat(F.lit(" "), word(2))),
        ("uuid", 0, F.lit("request id "), F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(" done")),
        ("card", 0, F.concat(word(1), F.lit(" ")), F.concat(F.lit("4"), F.lpad(F.pmod(F.xxhash64("id", F.lit("card")), F.lit(10**15)).cast("string"), 15, "0")), F.concat(F.lit(" "), word(2))),
        ("order_number", 0, F.lit("order number "), F.lpad(F.pmod(F.xxhash64("id", F.lit("order")), F.lit(10**15)).cast("string"), 18, "2"), F.lit(".")),
        ("path", 0, F.lit("see /"), F.concat_ws("/", word(1), word(2), word(3), F.col("id").cast("string")), F.lit(".html")),
        ("identifier", 0, F.concat(word(4), F.lit(" ")), F.concat_ws("_", word(1), word(2), word(3), F.col("id").cast("string")), F.lit("(")),
        ("slug", 0, F.lit("http://www."), F.concat_ws("-", word(1), word(2), word(3), word(5), F.col("id").cast("string")), F.lit("/")),
        ("placeholder", 0, F.lit("password="), F.concat(F.lit("your-"), word(1), F.lit("-placeholder-"), F.col("id").cast("string")), F.lit(" ")),
        ("constant", 0, F.lit("\n"), F.concat_ws("_", F.upper(word(1)), F.upper(word(2)), F.lit("SECRET_KEY")), F.lit("=")),
        ("shouted", 0, F.concat(F.upper(word(4)), F.lit("!! ")), F.upper(F.concat(word(1), word(2), word(3), word(5))), F.lit("!! ")),
        ("capital_key", 1, F.concat(word(1), F.lit(" ")), F.concat(F.lit("AKIA"), F.translate(F.substring(plain, 1, 16), "0123456789", "GHJKLMNPRS")), F.concat(F.lit(" "), word(2))),
        ("long_word", 0, F.concat(word(4), F.lit(" ")), F.concat(word(1), word(2), word(3), F.pmod(F.col("id"), F.lit(10)).cast("string")), F.concat(F.lit(" "), word(5))),
        ("short_password", 1, F.lit("password="), F.substring(digest, F.lit(1), short), F.lit(" ")),
        ("short_base", 1, F.lit("db_password: '"), F.substring(base, F.lit(1), short), F.lit("'")),
        ("short_words", 1, F.lit("and password="), F.concat(word(1), F.pmod(F.col("id"), F.lit(100)).cast("string"), word(2)), F.lit(" ")),
        ("letters", 1, F.lit("SECRET_KEY="), F.substring(F.translate(base, "0123456789-_", "xKqZvBwTjRgH"), F.lit(1), either), F.lit("\n")),
        ("lower_letters", 1, F.lit("token: "), F.substring(F.translate(digest, "0123456789", "xkqzvwtjrg"), F.lit(1), either), F.lit(" ")),
        ("signs", 1, F.lit("passwd="), F.regexp_replace(F.substring(base, F.lit(1), either), "^(..)(..)(.)", "$1!$2@$3\\$."), F.lit(" ")),
        ("assigned_word", 0, F.lit("the key: "), F.rpad(word(1), 6, "s"), F.concat(F.lit(" "), word(2))),
        ("assigned_name", 0, F.lit("password = "), F.concat_ws(".", word(1), word(2), word(3)), F.lit("\n")),
        ("assigned_call", 0, F.lit("token = "), F.concat(F.lit("get_"), word(1), F.lit("("), word(2)), F.lit(")\n")),
        ("assigned_kind", 0, F.lit("password: "), F.element_at(F.array(*map(F.lit, NOTHING)), (F.pmod(F.col("id"), F.lit(len(NOTHING))) + 1).cast("int")), F.lit("\n")),
        ("bare_letters", 1, F.concat(word(1), F.lit(" ")), F.substring(letters, F.lit(1), size), F.concat(F.lit(" "), word(2))),
        ("camel_case", 0, F.concat(word(4), F.lit(" ")), F.concat(word(1), capital(2), capital(3), capital(5)), F.lit("(")),
        ("class_name", 0, F.concat(word(4), F.lit(" ")), F.concat(capital(1), capital(2), capital(3), capital(5)), F.concat(F.lit(" "), word(6))),
        ("live_key", 1, F.concat(word(1), F.lit(" ")), F.concat(F.lit("sk_live_"), F.lower(F.substring(letters, 1, 20))), F.concat(F.lit(" "), word(2))),
        ("test_name", 0, F.concat(word(1), F.lit(" ")), F.concat_ws("_", word(1), word(2), F.lit("live"), word(3), word(5)), F.concat(F.lit(" "), word(2))),
        ("key_block", 1, F.lit("\n"), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base, base, F.lit("\n-----END RSA PRIVATE KEY-----")), F.lit("\n")),
        ("user_info", 1, F.lit("postgres://"), F.concat(word(1), F.lit(":"), F.substring(base, F.lit(1), short)), F.concat(F.lit("@"), word(2))),
        ("user_words", 1, F.lit("mysql://"), F.concat(F.lit("user:"), word(1), F.pmod(F.col("id"), F.lit(100)).cast("string"), word(2)), F.concat(F.lit("@"), word(3))),
        ("user_placeholder", 0, F.lit("http://"), F.element_at(F.array(*map(F.lit, ("user:password", "user:pass", "username:${PASSWORD}", "user:<password>", "name:xxxxxx"))), (F.pmod(F.col("id"), F.lit(5)) + 1).cast("int")), F.concat(F.lit("@"), word(3))),
        ("assigned_link", 0, F.lit("api: "), F.concat(F.lit("https://"), word(1), F.lit(".org/"), word(2)), F.lit(" ")),
    ]
    rows = None
    for kind, secret, before, candidate, behind in kinds:
        own = spark.range(0, examples, 1, 1).withColumn("kind", F.lit(kind)).select(
            candidate.alias("candidate"), before.alias("before"), behind.alias("behind"), F.lit(secret).alias("secret")
        )
        rows = own if rows is None else rows.unionByName(own)
    assigned = F.concat("before", "candidate").rlike(ASSIGNED)
    return rows.where((F.length("candidate") >= 16) | assigned | F.endswith("before", F.lit("://")))


@dataclass
class SecretModel:
    """A fitted forest."""

    forest: RandomForestClassificationModel

    @classmethod
    def fit(cls, findings: DataFrame) -> SecretModel:
        """findings: candidate, before, behind, secret (0/1); rows with a null are left out."""
        rows = _vectors(findings.dropna(subset=["candidate", "before", "behind", "secret"]), ["secret"])
        forest = RandomForestClassifier(
            labelCol="secret", featuresCol="features", numTrees=40, maxDepth=8, featureSubsetStrategy="sqrt", seed=3
        ).fit(rows.coalesce(4))
        return cls(forest)

    def score(self, found: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` and score, the share of the forest's vote for a secret."""
        scored = self.forest.transform(_vectors(found, keep))
        return scored.select(*keep, vector_to_array("probability")[1].alias("score"))


def _vectors(rows: DataFrame, keep: list[str]) -> DataFrame:
    numbers = features()
    named = rows.select(*keep, *(column.alias(f"f_{name}") for name, column in numbers.items()))
    assembled = VectorAssembler(inputCols=[f"f_{name}" for name in numbers], outputCol="features").transform(named)
    return assembled.select(*keep, "features")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, number, candidate, before, behind, score and secret of every candidate.

    docs: doc_id, text (null: no candidates); other columns are left out. Repeated rows
    give their candidates again. No row is shuffled: each text is scanned where it lies.
    """
    model = SecretModel.fit(labelled_findings(docs.sparkSession) if findings is None else findings)
    keep = ["doc_id", "number", "candidate", "before", "behind"]
    scored = model.score(candidates(docs.select("doc_id", "text")), keep)
    return scored.withColumn("secret", F.col("score") >= threshold)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document: doc_id, number, length, digest, score, secret."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("number").cast("long").alias("number"),
        F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        "score",
        "secret",
    )
