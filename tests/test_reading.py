"""What the text reader makes of sentences: token boundaries, contexts, ranges, headings, negation and degrees."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from quarrylight.functions.text import skill_name
from quarrylight.operators import mentions, reading


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def names(spark, texts, words=None):
    found = defaultdict(set)
    for r in reading.read(frame(spark, texts), "id", "text", words)["mentions"].collect():
        found[r.id].add(r.name)
    return [found[i] for i in range(len(texts))]


def test_names_count_as_whole_tokens(spark):
    texts = [
        "Redistribution of kafkaesque rustic goods in Gothenburg", "redis,kafka;rust", "We moved billing from MySQL (5.7) to PostgreSQL.", "Kotlin's coroutines", "htmlx cssy xhtml",
        "Drupal, mentored by anna@docker.com; slides at https://terraform.io/kubernetes", "charts.js and angular.js", "Terra-\nform modules and Kuber-\nnetes clusters",
    ]
    got = names(spark, texts)
    assert got[0] == set() and got[1] == {"Redis", "Kafka", "Rust"} and got[2] == {"MySQL", "PostgreSQL"} and got[3] == {"Kotlin"}
    assert got[4] == set() and got[5] == set() and got[6] == set() and got[7] == {"Terraform", "Kubernetes"}


def test_the_longest_name_wins_and_marks_belong_to_it(spark):
    got = names(spark, ["Apache Spark pipelines", "sql optimization, then plain sql", "asp.net next to c#", "F# or C++?", "Tools: C/C++", "ci/cd on aws/terraform"])
    assert got == [{"Apache Spark"}, {"SQL Optimization", "SQL"}, {"ASP.NET", "C#"}, {"C++"}, {"C", "C++"}, {"CI/CD", "AWS", "Terraform"}]


def test_words_of_daily_use_need_a_context(spark):
    sure = ["Kotlin, Swift, Java", "Hadoop, Spark and Airflow operators", "Express middleware written in TypeScript", "Statistics with R and Python", "Tools: Go"]
    unsure = ["a swift answer to the customer", "They go home at five", "This idea may spark interest", "the express lane", "Vitamin C helps", "Head of R&D", "Swift delivery of parcels"]
    assert all(names(spark, sure)) and {"Swift", "Apache Spark", "Express.js", "R", "Go"} <= set().union(*names(spark, sure))
    assert names(spark, unsure) == [set()] * len(unsure)


def test_marks_of_letters_are_optional(spark):
    plain, marked = names(spark, ["Biet hoc may va tieng anh", "Biết học máy và tiếng Anh"])
    assert plain == marked == {"Machine Learning", "English"}


def test_a_vocabulary_is_a_table(spark):
    seven, long = "one two three four five six seven", "a" * 200
    words = spark.createDataFrame([("loom", "Loom", "tool", None), ("spinning jenny", "Jenny", "tool", "MILL"), ("jenny", "Other", "tool", None), (long, "Long", "tool", None), (seven, "Seven", "tool", None), ("two three", "Inner", "tool", None)], "alias string, name string, kind string, category string")
    texts = ["Loom and spinning jenny, not Python", f"jenny {long}", f"{seven} two three", "Loom's jenny/loom", "spinning jenny's"]
    want = [{"Loom", "Jenny"}, {"Other", "Long"}, {"Seven", "Inner"}, {"Loom", "Other"}, {"Jenny"}]
    assert names(spark, texts, words) == want
    mentions.BLOCK, kept = 9, mentions.BLOCK
    try:  # a vocabulary of many blocks gives the same
        assert names(spark, texts, words) == want
    finally:
        mentions.BLOCK = kept
    assert names(spark, ["Loom"], words.limit(0)) == [set()]


def test_contexts_are_columns_of_the_vocabulary(spark):
    rows = [("mill", "Mill", "tool", None, ["Mill"], ["weaver", "cotton trade"], ["pepper"], ["stone"]), ("loom", "Loom", "tool", None, [], [], [], []), ("rome", "Rome", "place", None, [], [], [], [])]
    words = spark.createDataFrame(rows, "alias string, name string, kind string, category string, forms array<string>, cues array<string>, deny_before array<string>, deny_after array<string>")
    texts = [
        "A weaver of the Mill", "the Mill in the cotton trade", "a weaver at the mill", "pepper Mill of a weaver", "a weaver's Mill stone", "a Mill stonemason and weaver", "Mill", "Skills: Mill",
        "Loom, Mill", "Mill or Loom", "Loom. Mill", "Rome, Mill", "- Loom\n- Mill\n- Mill", "Loom and\nMill", "Loom\n\nelsewhere\nMill", "Loom, pepper Mill", "Loom with a long sentence between, Mill",
    ]
    yes = [True, True, False, False, False, True, False, True, True, True, False, False, True, True, False, False, False]
    assert ["Mill" in n for n in names(spark, texts, words)] == yes
    chain = "Loom, " + ", ".join(["Mill"] * 500)
    found = reading.read(frame(spark, [chain, ", ".join(["Mill"] * 500) + " & Loom", ", ".join(["Mill"] * 500)]), "id", "text", words)["mentions"].groupBy("id").count().collect()
    assert dict(map(tuple, found)) == {0: 501, 1: 501}  # both ways, at any length


def years(spark, texts):
    got = dict(reading.read(frame(spark, texts), "id", "text")["years"].collect())
    return [got[i] for i in range(len(texts))]


def test_years_of_experience(spark):
    stated = {
        "7+ years of experience in payments": 7, "between jobs: 8-11 years of experience": 8, "Kinh nghiệm: 6-9 năm": 6, "Tối thiểu 7 năm kinh nghiệm": 7, "Eight years of experience with compilers": 8,
        "at least 9 years": 9, "30 months of experience": 2.5, "Yêu cầu: kinh nghiệm 12 tháng": 1, "Requirements:\n- Rust\n- 6 years in embedded work": 6, "Requirements: 4 yoe": 4,
    }
    assert years(spark, list(stated)) == list(stated.values())


def test_other_years_are_no_experience(spark):
    texts = ["A firm with 30 years of history", "The tool is 9 years old", "Hợp đồng 3 năm", "Founded 40 years ago", "Không yêu cầu 2 năm kinh nghiệm", "No numbers"]
    assert years(spark, texts) == [0] * len(texts)


def test_titles_outvote_skills(spark):
    titles = {
        "Senior Frontend Engineer\nRust, Java": "FRONTEND", "Back-end Developer": "BACKEND", "Full-stack Developer\nReact": "FULLSTACK", "DevOps Lead": "DEVOPS_SRE", "Cloud Engineer\nTerraform, AWS": "CLOUD",
        "Data Scientist": "DATA_SCIENCE", "Site Reliability Engineer": "DEVOPS_SRE", "Engineer\nSelenium, Postman, JMeter": "QA_AUTOMATION", "Gardener": "UNCLASSIFIED",
    }
    rows = reading.read(frame(spark, list(titles)), "id", "text")["categories"].collect()
    got = {r.id: r.category for r in rows}
    assert [got[i] for i in range(len(titles))] == list(titles.values())


def requirements(spark, text):
    got = defaultdict(list)
    for r in reading.read(frame(spark, [text]), "id", "text")["requirements"].orderBy("kind", "rank").collect():
        got[r.kind].append(r.name)
    return got["required"], got["preferred"]


def test_headings_set_what_lines_below_them_mean(spark):
    text = "Mobile Developer\nRequirements:\n- Kotlin and Git\n- Redis\n\nNice to have:\n- Docker, Terraform\n\nWe offer:\n- AWS vouchers"
    assert requirements(spark, text) == (["Kotlin", "Git", "Redis"], ["Docker", "Terraform"])
    text = "Lập trình viên\nYêu cầu:\n- Java, MongoDB\nƯu tiên:\n- Kafka\nQuyền lợi:\n- Selenium"
    assert requirements(spark, text) == (["Java", "MongoDB"], ["Kafka"])


def test_cues_inside_a_clause_come_first(spark):
    text = "Developer\nMust have: Rust and Redis. Experience with Hadoop is a plus.\nPostman would be appreciated. Java is not needed.\nAbout us: our team ships with Vue."
    assert requirements(spark, text) == (["Rust", "Redis"], ["Hadoop", "Postman"])
    assert requirements(spark, "Tester\nGit. Jira là lợi thế. Không yêu cầu Selenium. Git") == (["Git"], ["Jira"])


def test_what_is_required_isnt_preferred_too(spark):
    assert requirements(spark, "Analyst\nSQL, Python\nNice to have: Python, dbt") == (["SQL", "Python"], ["dbt"])


#: Blocks of a posting, with what they require and prefer.
BLOCKS = [
    ("Requirements:\n- Kotlin and Git\n- Redis\n", ["Kotlin", "Git", "Redis"], []), ("Must have: Rust; Kafka. We like tea.\n\n", ["Rust", "Kafka"], []), ("- MySQL (required)\n", ["MySQL"], []),
    ("Nice to have\n- Docker\n- Terraform\nRequirements\n- CSS\n", ["CSS"], ["Docker", "Terraform"]), ("Nice: Docker; Terraform. HTML is needed.\n\n- Vue\n", ["HTML", "Vue"], ["Docker", "Terraform"]),
    ("Selenium is a plus.\n", [], ["Selenium"]), ("Java, Selenium or Postman would be appreciated.\n", ["Java"], ["Selenium", "Postman"]), ("MongoDB (Selenium, Postman) is a plus.\n", ["MongoDB"], ["Selenium", "Postman"]),
    ("Airflow, ideally Jira.\n", ["Airflow"], ["Jira"]), ("Hadoop is not required, Snowflake is.\n", ["Snowflake"], []), ("Hadoop is not required but a plus.\n", [], ["Hadoop"]), ("No need for Hadoop or Jira, but FastAPI.\n", ["FastAPI"], []),
    ("Our team uses Spring Boot and Kubernetes, but you will work in TypeScript.\n", ["TypeScript"], []), ("We use Kubernetes daily.\n", [], []), ("About us: a Kubernetes shop.\n\n", [], []), ("We offer:\n- AWS vouchers\nRequirements:\n", [], []),
    ("Ưu tiên: Docker; Terraform\n\n", [], ["Docker", "Terraform"]), ("Không yêu cầu Selenium nhưng cần dbt.\n", ["dbt"], []), ("Selenium là lợi thế.\n", [], ["Selenium"]), ("Quyền lợi:\n- Jira\nYêu cầu:\n- PostgreSQL\n", ["PostgreSQL"], []),
]


def test_blocks_of_postings_in_any_order(spark):
    """Postings put together from blocks: what each requires and prefers is known, whatever stands around it."""
    rng = random.Random(17)
    texts, want = [], []
    for n in range(len(BLOCKS) + 60):
        chosen = [BLOCKS[n]] if n < len(BLOCKS) else rng.sample(BLOCKS, rng.randint(2, 6))
        required = list(dict.fromkeys(x for _, r, _ in chosen for x in r))
        preferred = [x for x in dict.fromkeys(x for _, _, p in chosen for x in p) if x not in required]
        texts.append("Developer\n" + "".join(t + ("\nRequirements:\n" if i + 1 < len(chosen) else "") for i, (t, _, _) in enumerate(chosen)))
        want.append((required, preferred))
    got = defaultdict(lambda: ([], []))
    for r in reading.read(frame(spark, texts), "id", "text")["requirements"].orderBy("id", "kind", "rank").collect():
        got[r.id][r.kind == "preferred"].append(r.name)
    for i, text in enumerate(texts):
        assert got[i] == want[i], text


def test_concepts_of_a_title_describe_the_role(spark):
    assert requirements(spark, "Machine Learning Developer\nPython") == (["Python"], [])
    assert requirements(spark, "Machine Learning Developer\nPython, machine learning") == (["Machine Learning", "Python"], [])
    assert requirements(spark, "Python Developer\nGit") == (["Python", "Git"], []) and requirements(spark, "Machine Learning and Python") == (["Machine Learning", "Python"], [])


def test_votes_have_weights_margins_and_a_second(spark):
    weights = spark.createDataFrame([("alpha", "A", 2.0), ("beta", "B", 2.0), ("gamma", "C", 0.5), ("both", "A", 1.0), ("both", "B", 1.0)], "alias string, category string, weight double")
    words = spark.createDataFrame([("saw", "Saw", "tool", "A|B"), ("axe", "Axe", "tool", "B")], "alias string, name string, kind string, category string")
    texts = [
        "Alpha", "title\nalpha alpha", "gamma", "Alpha\nbeta", "alpha beta", "Alpha\nbeta beta axe, saw", "x\naxe alpha", "Both", "both\naxe", "x\nsaw", "alpha\nsaw axe", "none",
    ]
    # A 2 | A 1 | C .5 is too little | A 2, B 1 | A 2, B 2, titles alike | A 2.5, B 2.5, the title prefers A | B 1, A 1 no title | tie | title tie, B leads by 2/1 | .5 | A 2.5, B 1.5
    want = [("A", None), ("A", None), (None, None), ("A", "B"), (None, None), ("A", "B"), (None, None), (None, None), ("B", "A"), (None, None), ("A", "B"), (None, None)]
    parts = reading.clauses(frame(spark, texts), "id", "text")
    found = mentions.mentions(parts, words, "id", reading.SKILLS)
    got = {r.id: (None if r.category == "UNCLASSIFIED" else r.category, r.secondary) for r in reading.categories(parts, found, "id", weights).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_levels_degrees_and_languages(spark):
    texts = ["Junior Tester\nBachelor of Arts, English and Vietnamese. CEH", "Thực tập\nThạc sĩ. TOEIC 800", "PhD (incomplete). Master's degree", "BSc. currently pursuing an MSc", ""]
    got = {r.id: r for r in reading.read(frame(spark, texts), "id", "text")["attributes"].collect()}
    assert (got[0].level, got[0].education, got[0].languages, got[0].certifications) == ("Junior", "Bachelor", "English|Vietnamese", "CEH")
    assert (got[1].level, got[1].education, got[1].languages) == ("Intern", "Master", "English")
    assert got[2].education == "Master" and got[3].education == "Bachelor" and got[4].education is None


CV = """Lan Pham
SUMMARY
Engineer with 6.5 years in logistics.
Skills:
- Rust, Redis and
  PostgreSQL
- Docker
Work experience
Harbour Ltd., 4 years: built services in Kotlin
Hobbies
Selenium mining, Hadoop the elephant
Languages: \nEnglish"""


def test_sections_of_a_cv(spark):
    rows = reading.cv_sections(frame(spark, [CV, "no headings\nat all", ""]), "id", "text").orderBy("id", "line").collect()
    assert [(r.section, r.value) for r in rows if r.id == 0] == [
        ("head", "Lan Pham"), ("summary", "Engineer with 6.5 years in logistics."), ("skills", "Rust, Redis and PostgreSQL"), ("skills", "Docker"),
        ("experience", "Harbour Ltd., 4 years: built services in Kotlin"), ("hobbies", "Selenium mining, Hadoop the elephant"), ("languages", "English"),
    ]
    assert [r.section for r in rows if r.id == 1] == ["head", "head"] and not [r for r in rows if r.id == 2]


def test_profile_of_a_cv(spark):
    got = {r.id: r for r in reading.cv_profile(frame(spark, [CV, ""]), "id", "text").collect()}
    assert got[0].skills == ["Docker", "Kotlin", "PostgreSQL", "Redis", "Rust"] and got[0].languages == ["English"]
    assert (got[0].years, got[0].summary) == (6.5, "Engineer with 6.5 years in logistics.")
    assert (got[1].skills, got[1].years, got[1].summary) == ([], 0.0, "")


def test_enrichment(spark):
    rows = [(1, ["Old Rust", "weaving"], "", 0.0, "v1"), (2, ["rust"], "mine", 3.0, "v2"), (3, None, None, None, None)]
    own = spark.createDataFrame(rows, "id long, skills array<string>, summary string, years double, catalog_version string")
    read = spark.createDataFrame([(1, ["Rust"], "read", 2.0), (2, ["Go"], "read", 9.0)], "id long, skills array<string>, summary string, years double")
    catalog = spark.createDataFrame([("Old Rust",), ("rust",)], "name string").withColumn("norm", skill_name(F.col("name")))
    got = {r.id: tuple(r)[1:] for r in reading.enriched(own, read, "id", "v2", catalog).collect()}
    assert got == {1: (["Rust", "weaving"], "read", 2.0, "merged"), 2: (["rust"], "mine", 3.0, "provided"), 3: ([], None, None, "merged")}


def test_years_stated(spark):
    rows = frame(spark, ["2,5 năm rồi 4 years", "none", "11 yrs and 3+ years"]).select("id", reading.years_stated(F.col("text")).alias("y")).orderBy("id").collect()
    assert [r.y for r in rows] == [4.0, None, 11.0]


def test_junk_is_read_in_time(spark):
    texts = ["z" * 70_000, "+" * 70_000, "7" * 60_000 + " years of experience", "Redis, " * 8_000, "* " * 30_000, "[" * 40_000, "a@" * 30_000, "a." * 35_000 + "@"]
    names(spark, ["warm up"])
    start = time.perf_counter()
    rows = reading.read(frame(spark, texts), "id", "text")["mentions"].groupBy("id").count().collect()
    assert dict(map(tuple, rows)) == {3: 8_000} and time.perf_counter() - start < 60
