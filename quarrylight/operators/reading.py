"""Rule-based reading of job descriptions and résumés: text becomes rows of clauses, the vocabulary is a table.

The entries below are this repository's own, and only a default: any vocabulary table can be read with. What is
fixed is the behaviour on sentences. Names are found by mentions.py; the rules are windows and joins over its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, skill_name
from .joins import dealt
from .mentions import beside, mentions

#: Own vocabulary, fixed values: name, kind, category, aliases ("!" before an alias that needs a context).
VOCABULARY = [
    ("Python", "language", None, "python"),
    ("Java", "language", "BACKEND", "java"),
    ("JavaScript", "language", "FRONTEND", "javascript"),
    ("TypeScript", "language", "FRONTEND", "typescript"),
    ("Go", "language", "BACKEND", "golang,!go"),
    ("Rust", "language", "BACKEND", "rust"),
    ("C", "language", None, "!c"),
    ("C++", "language", None, "c++"),
    ("C#", "language", "BACKEND", "c#"),
    ("R", "language", None, "!r"),
    ("Swift", "language", "MOBILE", "!swift"),
    ("Kotlin", "language", "MOBILE", "kotlin"),
    ("SQL", "language", None, "sql"),
    ("SQL Optimization", "concept", None, "sql optimization"),
    ("Statistics", "concept", None, "statistics"),
    ("Machine Learning", "concept", "DATA_SCIENCE", "machine learning,hoc may"),
    ("NLP", "concept", "DATA_SCIENCE", "nlp,xu ly ngon ngu tu nhien,natural language processing"),
    ("PostgreSQL", "database", "BACKEND", "postgresql,postgres"),
    ("MySQL", "database", "BACKEND", "mysql"),
    ("MongoDB", "database", "BACKEND", "mongodb"),
    ("Redis", "database", "BACKEND", "redis"),
    ("Snowflake", "database", "DATA_ENGINEERING", "snowflake"),
    ("Kafka", "tool", "DATA_ENGINEERING", "kafka"),
    ("Airflow", "tool", "DATA_ENGINEERING", "airflow"),
    ("dbt", "tool", "DATA_ENGINEERING", "dbt"),
    ("ETL", "concept", "DATA_ENGINEERING", "etl"),
    ("Apache Spark", "tool", "DATA_ENGINEERING", "apache spark,!spark"),
    ("Hadoop", "tool", "DATA_ENGINEERING", "hadoop"),
    ("FastAPI", "framework", "BACKEND", "fastapi"),
    ("Spring Boot", "framework", "BACKEND", "spring boot"),
    ("REST API", "concept", "BACKEND", "rest api"),
    ("Node.js", "framework", "BACKEND", "node.js,nodejs"),
    ("Express.js", "framework", "BACKEND", "express.js,!express"),
    ("ASP.NET", "framework", "BACKEND", "asp.net"),
    ("React", "framework", "FRONTEND", "react,react.js,reactjs"),
    ("Next.js", "framework", "FRONTEND", "next.js,nextjs"),
    ("Vue", "framework", "FRONTEND", "vue,vue.js"),
    ("HTML", "language", "FRONTEND", "html"),
    ("CSS", "language", "FRONTEND", "css"),
    ("Tailwind", "framework", "FRONTEND", "tailwind"),
    ("Xcode", "tool", "MOBILE", "xcode"),
    ("Android", "tool", "MOBILE", "android"),
    ("Docker", "tool", "DEVOPS_SRE", "docker"),
    ("Kubernetes", "tool", "DEVOPS_SRE", "kubernetes,k8s"),
    ("Terraform", "tool", "CLOUD", "terraform"),
    ("AWS", "cloud", "CLOUD", "aws"),
    ("CI/CD", "concept", "DEVOPS_SRE", "ci/cd"),
    ("TCP/IP", "concept", None, "tcp/ip"),
    ("Git", "tool", None, "git"),
    ("Selenium", "tool", "QA_AUTOMATION", "selenium"),
    ("Postman", "tool", "QA_AUTOMATION", "postman"),
    ("JMeter", "tool", "QA_AUTOMATION", "jmeter"),
    ("Jira", "tool", None, "jira"),
    ("ISTQB", "certification", "QA_AUTOMATION", "istqb"),
    ("CEH", "certification", "SECURITY", "ceh"),
    ("Azure AZ-104", "certification", "CLOUD", "az-104"),
    ("English", "spoken_language", None, "english,tieng anh,ielts,toeic"),
    ("Vietnamese", "spoken_language", None, "vietnamese,tieng viet"),
    ("Bachelor", "education", "2", "bachelor,bachelor's,beng,bsc,cu nhan"),
    ("Master", "education", "3", "master of science,master's,msc,thac si"),
    ("Doctor", "education", "4", "phd,tien si"),
    ("Intern", "level", "1", "intern,thuc tap"),
    ("Junior", "level", "2", "junior"),
    ("Senior", "level", "4", "senior"),
]
#: Fixed words of a title that vote for a category, three times as strongly as a skill.
TITLES = [
    ("frontend", "FRONTEND"), ("front-end", "FRONTEND"), ("backend", "BACKEND"), ("back-end", "BACKEND"), ("fullstack", "FULLSTACK"), ("full-stack", "FULLSTACK"),
    ("mobile", "MOBILE"), ("data engineer", "DATA_ENGINEERING"), ("data scientist", "DATA_SCIENCE"), ("qa", "QA_AUTOMATION"), ("devops", "DEVOPS_SRE"),
    ("site reliability", "DEVOPS_SRE"), ("cloud", "CLOUD"), ("security", "SECURITY"),
]
SKILLS = ("language", "framework", "tool", "database", "cloud", "concept", "soft_skill")
#: Own cues, folded: heads of sections and what these make of the lines below, and how a clause speaks of a name in it.
SECTIONS = {
    "preferred": r"(?:uu tien|loi the|diem cong|nice(?: to have)?|preferred|bonus|good to have|desirable|plus)\b",
    "none": r"(?:quyen loi|phuc loi|we offer|benefits|about us|about the company|ve chung toi|cong ty|our team|our company|our stack|not required|khong yeu cau)\b",
    "required": r"(?:requirements?|yeu cau|must have|required|qualifications|what you need|you have|ky nang|trach nhiem|responsibilities)\b",
}
HEAD_CHARS, BARE_CHARS, HEAD_WORDS = 50, 40, 6
COMPANY = r"^\W*(?:our (?:team|company|product|platform|stack)|we (?:use|run|are|build)|the company|cong ty|chung toi)\b"
TURN = r"\b(?:but you|you will|nhung ban|ban se)\b"
NEGATED_BEFORE = r"(?:khong (?:yeu cau|can|bat buoc)|not (?:required|needed|necessary)|no need (?:for|of)|without|instead of)\b[^,;]*$"
NEGATED_AFTER = r"^[^,;]*?\b(?:(?:is|are) not (?:required|needed|necessary)|isn't (?:required|needed)|not (?:required|needed)|khong (?:bat buoc|can thiet|yeu cau))\b"
SOFTENED = r"(?:but|though|nhung)\b.*\b(?:plus|welcome|nice|preferred|loi the)\b"
PREFERRED_BEFORE = r"\b(?:uu tien|preferably|ideally|nice to have|bonus for|co the hoc)\b[^.;]*$"
PREFERRED_AFTER = r"^(?:[\s,)]*[\p{L}]+){0,3}?[\s,)]*(?:is|are|la|se la)?\s*(?:an? )?(?:(?:big |strong )?plus|nice to have|bonus|advantage|loi the|diem cong|preferred|would be (?:appreciated|nice|a plus))\b"


#: Own contexts of aliases in doubt: words nearby that settle it, and words right before and behind that deny it.
CODING = ("developer", "developers", "engineer", "programming", "language", "languages", "lap trinh", "code", "framework", "backend", "middleware", "library", "compiler", "ky nang")
CONTEXTS = {
    "go": ((*CODING, "goroutines", "microservices"), ("to", "we", "they", "let", "always"), ("to", "home", "live", "public", "ahead", "back", "through")),
    "c": ((*CODING, "embedded", "firmware", "kernel"), ("vitamin", "hepatitis", "grade", "series", "plan"), ("level", "suite", "section")),
    "r": ((*CODING, "statistics", "ggplot", "tidyverse"), ("toys",), ("d", "rated")),
    "swift": ((*CODING, "ios", "iphone", "xcode", "uikit"), ("taylor", "a"), ("code", "delivery", "response", "transfer", "reply", "payments")),
    "spark": ((*CODING, "hadoop", "jobs", "cluster", "streaming", "etl"), ("may", "to", "could", "will"), ("interest", "of", "plug", "joy", "debate")),
    "express": ((*CODING, "node", "routes", "server"), ("american", "orient", "to"), ("lane", "delivery", "train", "your", "interest")),
}


def vocabulary(spark: SparkSession) -> DataFrame:
    """(alias, name, kind, category, forms, cues, deny_before, deny_after): a row for each alias of the built-in words.
    An alias marked as in doubt must begin with a capital."""
    rows = []
    for name, kind, category, aliases in VOCABULARY:
        for a in aliases.split(","):
            alias = a.lstrip("!")
            rows.append((alias, name, kind, category, *(([alias.capitalize()], *map(list, CONTEXTS[alias])) if a.startswith("!") else ([],) * 4)))
    return spark.createDataFrame(rows, "alias string, name string, kind string, category string, forms array<string>, cues array<string>, deny_before array<string>, deny_after array<string>")


def clauses(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, clause, original, folded): lines cut behind sentence ends and semicolons, addresses blanked,
    hyphenated breaks joined. An empty line is a clause without text."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"(?<!\S)[^\s@]++@\S++|https?://\S+|\b[\w-]+\.(?:net|com|org)\b(?<!(?i)asp\.net)", " ")
    lines = docs.select(key, F.posexplode(F.split(clean, "\n")).alias("line", "_l"))
    parts = lines.select(key, "line", F.posexplode(F.split("_l", r"(?<=[.!?])\s+|(?<=;)")).alias("clause", "original")).filter("trim(original) <> '' or clause = 0")
    return parts.withColumn("folded", fold(F.col("original")))


def years_required(parts: DataFrame, key: str) -> DataFrame:
    """(key, years): the low end of the first statement of required experience, months in half years; 0 without one."""
    words = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
    text = F.col("folded")
    for w, n in words.items():
        text = F.regexp_replace(text, rf"\b{w}\b(?= years?)", str(n))
    pattern = r"(?<!\d)(\d{1,2})(?:\s*-\s*\d{1,2})?\+?\s*(nam|years?|yoe|months?|thang)\b"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    about = text.rlike(r"kinh nghiem|experience|yoe|yeu cau|requirements?|\bin an?\b|toi thieu|it nhat|at least|minimum")
    other = text.rlike(r"history|years? old|hop dong|contract|khong yeu cau")
    head = F.max(F.when(F.col("folded").rlike(r"^\W*(requirements?|yeu cau)\b"), 1)).over(Window.partitionBy(key).orderBy("line", "clause"))
    years = F.when((about | head.isNotNull()) & ~other, F.when(unit.rlike("month|thang"), F.floor(number / 6) / 2).otherwise(number))
    stated = parts.withColumn("_y", years)
    return stated.groupBy(key).agg(F.coalesce(F.min_by("_y", F.when(F.col("_y") <= 40, F.struct("line", "clause"))), F.lit(0.0)).alias("years"))


def sections(parts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, line, clause, folded, section): what each clause is about, required, preferred or none, by the heads above.

    A head is a clause that begins like one of SECTIONS, before its colon or as a short line, and names nothing. Alone
    it holds for the rest of its line and the lines below, up to the next head. With text behind its colon it holds
    for that clause, for those that semicolons join to it and, up to an empty line, for the lines below; a head of
    requirements for the rest of its line, too. Without a head clauses are required.
    """
    head = F.substring_index("folded", ":", 1)
    colon = F.contains("folded", F.lit(":")) & (F.length(head) <= HEAD_CHARS)
    bare = F.regexp_replace(F.when(colon, head).otherwise(F.col("folded")), r"^[^\p{L}]+|\s+$", "")
    kind = reduce(lambda c, k: c.when(bare.rlike("^" + SECTIONS[k]), k), SECTIONS, F.when(bare.rlike("[0-9]") | (F.size(F.split(bare, r"\s+")) > HEAD_WORDS), F.lit(None)))
    opens = F.when((colon | (F.length(F.trim("folded")) <= BARE_CHARS)) & F.col("_first").isNull(), kind).when(colon & (F.col("_first") > F.length(head)), kind)
    first = found.groupBy(key, "line", "clause").agg(F.min("start").alias("_first"))
    told = parts.join(dealt(first), [key, "line", "clause"], "left").withColumn("_opens", opens)
    told = told.withColumn("_inline", F.when(F.col("_opens").isNotNull(), colon & (F.trim(F.substring_index("folded", ":", -1)) != ""))).withColumn("_empty", F.trim("folded") == "")
    order = Window.partitionBy(key).orderBy("line", "clause")
    line = Window.partitionBy(key, "line").orderBy("clause")
    last = lambda c, over: F.last(c, ignorenulls=True).over(over)
    ended = F.col("_empty") & last("_inline", order)
    event = F.when(F.col("_empty"), F.when(ended, "required")).otherwise(F.col("_opens"))
    told = told.withColumn("_event", event)
    above = last("_event", Window.partitionBy(key).orderBy("line").rangeBetween(Window.unboundedPreceding, -1))
    rest = last(F.when(~F.col("_inline") | (F.col("_opens") == "required"), F.col("_opens")), line)
    fresh = F.sum(F.when(F.coalesce(F.lag("folded").over(line).rlike(r";\s*$"), F.lit(False)), 0).otherwise(1)).over(line)
    told = told.withColumns({"_above": above, "_rest": rest, "_fresh": fresh})
    carried = last("_opens", Window.partitionBy(key, "line", "_fresh").orderBy("clause"))
    return told.select(key, "line", "clause", "folded", F.coalesce(carried, "_rest", "_above", F.lit("required")).alias("section"))


def requirements(parts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, kind, name, rank): required and preferred skills in order of mention, first mention only.

    Each name has its clause's section, see sections(), unless words around it say more: a negation before it with no
    comma between, or behind it, takes it out, softened ("not required but a plus") it is preferred; so it is behind a
    cue of preference, or before one ("is a plus"), which spreads back over the names that it is joined to in one
    enumeration. A clause about the company gives nothing up to where it turns to the reader. A concept that only the
    first of several lines names describes the role. What is required isn't preferred, too.
    """
    clause = Window.partitionBy(key, "line", "clause").orderBy("start", F.desc("end"), "name")
    skills = found.filter(F.col("kind").isin(*SKILLS, "certification"))
    inside = dealt(skills).join(dealt(sections(parts, found, key)), [key, "line", "clause"])
    before, after = F.substring(F.col("folded"), F.lit(1), F.col("start")), F.expr("substring(folded, end + 1)")
    reach = F.expr("substring(folded, greatest(1, start - 79), least(80, start))")
    ahead = F.lead("start").over(clause)
    cue = F.when(ahead.isNull(), after).otherwise(F.expr("substring(folded, end + 1, greatest(0, _ahead - end))"))
    gap = F.expr("substring(folded, _behind + 1, greatest(0, start - _behind))")
    depth = F.length(before) - F.length(F.replace(before, F.lit("("), F.lit(""))) - (F.length(before) - F.length(F.replace(before, F.lit(")"), F.lit(""))))
    linked = (F.length(gap) <= 40) & ~F.contains(gap, F.lit(";")) & (gap.rlike(r"(?<![\p{L}\p{N}])(?:and|or|va|hoac|plus)(?![\p{L}\p{N}])|[&/]") | (depth > 0) & ~F.contains(gap, F.lit("(")))
    told = inside.withColumns({"_ahead": ahead, "_behind": F.lag("end").over(clause)})
    told = told.withColumns({"_after": cue.rlike(PREFERRED_AFTER), "_linked": F.coalesce(linked, F.lit(False))})
    told = told.withColumn("_run", F.sum(F.when(F.col("_linked"), 0).otherwise(1)).over(clause))
    spread = F.max("_after").over(Window.partitionBy(key, "line", "clause", "_run").orderBy("start", F.desc("end"), "name").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    denied = after.rlike(NEGATED_AFTER)
    turned = F.col("folded").rlike(COMPANY) & ~before.rlike(TURN)
    status = (
        F.when(turned, "none").when((F.col("section") == "none") & ~before.rlike(TURN), "none").when(reach.rlike(NEGATED_BEFORE) & ~reach.rlike(r"(?:khong (?:yeu cau|can|bat buoc)|not \w+|without|no need)\b.*\b(?:but|nhung)\b"), "none")
        .when(denied, F.when(after.rlike(SOFTENED), "preferred").otherwise("none")).when(reach.rlike(PREFERRED_BEFORE) | F.col("_spread"), "preferred").when(F.col("section") == "none", "required").otherwise(F.col("section"))
    )
    graded = told.withColumn("_spread", spread).withColumn("state", status).filter("state <> 'none'")
    lines = parts.filter("trim(folded) <> ''").groupBy(key).agg(F.min("line").alias("_title"), F.max("line").alias("_end"))
    later = Window.partitionBy(key, "name")
    titled = (F.max("line").over(later) == F.col("_title")) & (F.col("_end") > F.col("_title")) & (F.col("kind") == "concept")
    named = dealt(graded).join(dealt(lines), key).withColumn("_role", titled).filter("not _role")
    first = named.groupBy(key, "state", "name").agg(F.min(F.struct("line", "clause", "place", "n")).alias("at"))
    needed = F.max(F.col("state") == "required").over(Window.partitionBy(key, "name"))
    kept = first.withColumn("_needed", needed).filter("state = 'required' or not _needed")
    rank = F.row_number().over(Window.partitionBy(key, "state").orderBy("at"))
    return kept.select(key, F.col("state").alias("kind"), "name", rank.alias("rank"))


#: Fixed rules of the vote: what a keyword counts outside the title, what a skill's vote counts, the least score, how far
#: the first must lead, and the share of it that makes the next one secondary.
BODY_FACTOR, SKILL_VOTE, LEAST_SCORE, MARGIN, SECONDARY = 0.5, 1.0, 1.0, 1.25, 0.5


def keywords(spark: SparkSession) -> DataFrame:
    """(alias, category, weight): the built-in titles as keywords of weight 3."""
    return spark.createDataFrame([(t, c, 3.0) for t, c in TITLES], "alias string, category string, weight double")


def category_votes(hits: DataFrame, skills: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, category, score, title_score): votes for every category that a text has any for.

    `hits` (key, alias, in_title) are the keywords found; each counts its weight once in the title and BODY_FACTOR of it
    once in the body, whatever it is repeated. Each of the distinct `skills` (key, name, category, categories joined
    by "|") splits one vote of SKILL_VOTE among its categories. Sums meet by key and category.
    """
    once = hits.groupBy(key, "alias").agg(F.max("in_title").alias("t"), F.max(~F.col("in_title")).alias("b"))
    weighed = beside(once, weights).select(key, "category", F.when(F.col("t"), F.col("weight")).otherwise(0.0).alias("t"), F.when(F.col("b"), F.col("weight") * BODY_FACTOR).otherwise(0.0).alias("b"))
    own = skills.filter("category is not null").select(key, "name", F.split("category", "[|]").alias("c")).distinct()
    split = own.select(key, F.explode("c").alias("category"), F.lit(0.0).alias("t"), (SKILL_VOTE / F.size("c")).alias("b"))
    return weighed.unionByName(split).groupBy(key, "category").agg(F.round(F.sum(F.col("t") + F.col("b")), 9).alias("score"), F.round(F.sum("t"), 9).alias("title_score"))


def ranked_categories(votes: DataFrame, key: str) -> DataFrame:
    """(key, category, secondary) of category_votes(); null where nothing stands out.

    The first needs LEAST_SCORE and MARGIN times the next one's score; too close to call, the title decides, if it
    scores enough and prefers one of the two. The next is secondary from SECONDARY of the first's score on. Ties go by
    name. A text has no more rows here than there are categories.
    """
    order = Window.partitionBy(key).orderBy(F.desc("score"), "category")
    two = votes.withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    of = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    pair = two.groupBy(key).agg(*(of(c, n).alias(f"{c}_{n}") for c in ("category", "score", "title_score") for n in (1, 2)))
    pair = pair.fillna(0.0, ["score_2", "title_score_2"])
    enough, clear = F.col("score_1") >= LEAST_SCORE, F.col("score_1") >= F.col("score_2") * MARGIN
    told = (F.greatest("title_score_1", "title_score_2") >= LEAST_SCORE) & (F.col("title_score_1") != F.col("title_score_2"))
    swapped = ~clear & (F.col("title_score_2") > F.col("title_score_1"))
    best, other = F.when(swapped, F.col("category_2")).otherwise(F.col("category_1")), F.when(swapped, F.col("category_1")).otherwise(F.col("category_2"))
    reach = F.when(swapped, F.col("score_1")).otherwise(F.col("score_2"))
    close = (F.least(reach, F.col("score_1")) >= F.col("score_1") * SECONDARY) & (reach >= LEAST_SCORE)
    picked = enough & (clear | told)
    return pair.select(key, F.when(picked, best).alias("category"), F.when(picked & close, other).alias("secondary"))


def keys_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the texts that have clauses: those that aren't null."""
    return docs.filter(F.col(text).isNotNull()).select(key).distinct()


def categories(parts: DataFrame, found: DataFrame, key: str, weights: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(key, category, secondary) of every text: keywords of the first line as the title's and of the others as the
    body's, and the skills that it names. UNCLASSIFIED where nothing stands out. With `keys`, see keys_of(), the texts
    aren't cut once more to list them."""
    listed = keywords(parts.sparkSession) if weights is None else weights
    as_words = listed.select("alias", F.col("alias").alias("name"), F.lit("keyword").alias("kind"), F.lit(None).cast("string").alias("category")).distinct()
    hits = mentions(parts, as_words, key, SKILLS).select(key, F.col("name").alias("alias"), (F.col("line") == 0).alias("in_title"))
    skills = found.filter(F.col("kind").isin(*SKILLS, "certification")).select(key, "name", "category")
    best = ranked_categories(category_votes(hits, skills, key, listed), key)
    return (parts.select(key).distinct() if keys is None else keys).join(dealt(best), key, "left").select(key, F.coalesce("category", F.lit("UNCLASSIFIED")).alias("category"), "secondary")


def attributes(parts: DataFrame, found: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, level, education, languages, certifications): the highest of the first two, sorted lists of the others.

    Degrees in a clause that says they are incomplete or being pursued don't count.
    """
    state = dealt(found).join(dealt(parts.select(key, "line", "clause", "folded")), [key, "line", "clause"])
    pending = F.col("folded").rlike(r"incomplete|pursuing|dang hoc") & (F.col("kind") == "education")
    rows = state.withColumn("_open", F.regexp_extract("folded", r"(incomplete|pursuing)", 1) != "").filter(~pending | (F.col("kind") != "education"))
    kind = lambda k: F.when(F.col("kind") == k, F.col("name"))
    rank = lambda k: F.when(F.col("kind") == k, F.col("category"))
    out = rows.groupBy(key).agg(
        F.max_by(kind("level"), rank("level")).alias("level"), F.max_by(kind("education"), rank("education")).alias("education"),
        F.array_join(F.array_sort(F.collect_set(kind("spoken_language"))), "|").alias("languages"),
        F.array_join(F.array_sort(F.collect_set(kind("certification"))), "|").alias("certifications"),
    )
    return (parts.select(key).distinct() if keys is None else keys).join(dealt(out), key, "left")


def read(docs: DataFrame, key: str, text: str, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """All readings of a table of texts by a vocabulary table, the built-in one by default: mentions, requirements,
    years, categories, attributes."""
    parts = clauses(docs, key, text)
    found = mentions(parts, vocabulary(docs.sparkSession) if words is None else words, key, SKILLS)
    keys = keys_of(docs, key, text)
    return {"mentions": found, "requirements": requirements(parts, found, key), "years": years_required(parts, key), "categories": categories(parts, found, key, keys=keys), "attributes": attributes(parts, found, key, keys)}


#: Fixed headings of a CV, folded, and the section that each begins; those in CLAIMS speak of the person's own skills.
HEADINGS = {
    "summary": ("summary", "profile", "about me", "muc tieu", "gioi thieu"), "skills": ("skills", "technical skills", "ky nang"), "experience": ("experience", "work experience", "employment", "kinh nghiem", "kinh nghiem lam viec"),
    "projects": ("projects", "du an"), "education": ("education", "hoc van"), "certifications": ("certifications", "certificates", "chung chi"), "languages": ("languages", "ngoai ngu"),
    "hobbies": ("hobbies", "interests", "so thich"), "references": ("references", "nguoi tham chieu"),
}
CLAIMS, HEADING_CHARS = ("head", "summary", "skills", "experience", "projects", "certifications"), 40
BULLET = r"^\s*[-•*▪●]\s*"


def cv_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, line, value): the lines of a CV under their headings; what comes before the first is "head".

    A heading is a line of up to HEADING_CHARS characters that is one of HEADINGS without its colon. Where a section
    has bullets, a line without one belongs to the bullet before it. Empty lines are left out.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line", "value")).filter("trim(value) <> ''")
    low = F.trim(F.regexp_replace(fold(F.trim("value")), r"[:：]\s*$", ""))
    named = F.create_map(*(F.lit(x) for section, names in HEADINGS.items() for name in names for x in (name, section)))
    heading = F.when(F.length(F.trim("value")) <= HEADING_CHARS, F.element_at(named, low))
    order = Window.partitionBy(key).orderBy("line")
    placed = lines.withColumn("_h", heading).withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(order), F.lit("head"))).filter("_h is null")
    bullet = F.col("value").rlike(BULLET)
    inside = Window.partitionBy(key, "section").orderBy("line")
    item = F.last(F.when(bullet, F.col("line")), ignorenulls=True).over(inside)
    joined = placed.withColumn("_i", F.coalesce(item, F.col("line"))).groupBy(key, "section", F.col("_i").alias("line"))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", F.trim(F.regexp_replace("value", BULLET, "")).alias("v")))), lambda p: p["v"]), " ")
    return joined.agg(pieces.alias("value"))


def cv_profile(docs: DataFrame, key: str, text: str, words: DataFrame | None = None) -> DataFrame:
    """(key, skills, certifications, languages, summary, years): skills only from sections that claim them, by name.

    Languages and certifications count wherever they stand; years is the largest number of years that a line of
    experience states.
    """
    sections = cv_sections(docs, key, text)
    lines = sections.select(F.struct(F.col(key).alias("k"), "section", "line").alias("id"), "value")
    found = mentions(clauses(lines, "id", "value"), vocabulary(docs.sparkSession) if words is None else words, "id", SKILLS).select(F.col("id.k").alias(key), F.col("id.section").alias("section"), "name", "kind")
    named = lambda kinds, here: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds) & here, F.col("name"))))
    skills = found.groupBy(key).agg(
        named(SKILLS, F.col("section").isin(*CLAIMS)).alias("skills"), named(["certification"], F.lit(True)).alias("certifications"), named(["spoken_language"], F.lit(True)).alias("languages")
    )
    told = sections.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == "summary", F.struct("line", "value")))), lambda s: s["value"]), " ").alias("summary"),
        F.max(F.when(F.col("section").isin("head", "summary", "experience"), years_stated(F.col("value")))).alias("years"),
    )
    none = F.array().cast("array<string>")
    return docs.select(key).join(dealt(told), key, "left").join(dealt(skills), key, "left").select(key, *(F.coalesce(c, none).alias(c) for c in ("skills", "certifications", "languages")), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("years", F.lit(0.0)).alias("years"))


def years_stated(text: Column) -> Column:
    """The largest number of years, with decimals, that a text states; null without one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\d{1,2}(?:[.,]\d)?)\s*\+?\s*(?:năm|years?|yrs?|yoe)"), F.lit(1))
    return F.array_max(F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double")))


def enriched(profiles: DataFrame, read: DataFrame, key: str, version: str, skills: DataFrame) -> DataFrame:
    """Profiles completed by what the reader found: (key, skills, summary, years, source).

    A profile's own extraction (skills, summary, years, catalog_version) is trusted where it was made with the same
    catalog version: source "provided". Else its skills that the catalog knows (`skills`: norm, name) give way to the
    reader's, unknown ones stay behind them, and an empty summary or years of 0 are filled in: source "merged".
    """
    own = profiles.select(key, F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), "summary", "years", "catalog_version")
    each = own.select(key, F.posexplode("skills").alias("place", "raw")).withColumn("norm", skill_name(F.col("raw")))
    unknown = each.join(skills.select("norm").distinct(), "norm", "left_anti").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "raw"))), lambda s: s["raw"]).alias("_unknown"))
    seen = read.select(key, F.col("skills").alias("_skills"), F.col("summary").alias("_summary"), F.col("years").alias("_years"))
    both = own.join(dealt(unknown), key, "left").join(dealt(seen), key, "left")
    same = F.coalesce(F.col("catalog_version") == version, F.lit(False))
    none = F.array().cast("array<string>")
    merged = F.array_union(F.coalesce("_skills", none), F.coalesce("_unknown", none))
    return both.select(
        key, F.when(same, F.col("skills")).otherwise(merged).alias("skills"),
        F.when(same | (F.coalesce(F.trim("summary"), F.lit("")) != ""), F.col("summary")).otherwise(F.col("_summary")).alias("summary"),
        F.when(same | (F.coalesce("years", F.lit(0.0)) > 0), F.col("years")).otherwise(F.col("_years")).alias("years"),
        F.when(same, "provided").otherwise("merged").alias("source"),
    )


def skill_line(names: Column) -> Column:
    return F.array_join(names, ", ")
