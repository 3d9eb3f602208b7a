"""The domain's relations over the fixture tables: workspaces, clients, jobs, candidates, applications and rankings."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.sources.spread import spread

#: All relative times are measured from here.
NOW = datetime(2001, 9, 1)
#: When the inbox is looked at, near the newest jobs.
INBOX_NOW = datetime(1998, 8, 1)
#: Candidates are 0 to 399 days old.
TITLES = ["Data Analyst", "Frontend Developer", "Backend Engineer", "DevOps Engineer", "UX Designer", "Machine Learning Engineer", "Full Stack Developer", "QA Tester"]
JOB_SKILLS = ["python, kafka, aws", "react/typescript, rest apis", "ci/cd, docker; kubernetes", "figma | communication", "postgresql, microservices, excel", "distributed, c\\go | excel"]
CANDIDATE_SKILLS = ["python, message queues, ec2", "react, typescript", "docker, kubernetes, cicd", "figma, teamwork", "postgres, distributed systems", "excel, python", "", "microservices; c, Go (selenium)"]
DEGREES = ["bachelors", "masters", "phd", "intermediate", "", "BSc  Physics", "MBA", "M. Phil", "diploma", "High School", "Ph.D"]
REQUIRED = ["any", "bachelors", "masters", "phd"]
DESCRIPTIONS = ["Minimum 3 years, bachelor's degree", "5-7 yrs of backend work; MSc preferred", "at least 2+ years", "10+ years of experience, PhD", "1 year of sql or 4 years of java", "No experience asked", ""]
PASTED_TOPS = ["People also viewed", "Ann Lee\nFigma (Software)", "Ad Choices.\nCommunity Guidelines", "Skills: python, not relevant", "12 endorsements\nJ Smith\nMary Jones", "Senior engineer · On-site", ""]
PASTED_MIDDLES = ["ACME!\nTurning clicks into customers", "5+ years in web design\nBoom! Sales went up", "I\u2019ve seen the same ad too often", "Adobe  XD\nWeb design.", "Led the team (on-site) for 3 years", "Our clients include Acme", " Sign in \nAbout!", "Tools: Not relevant, sql\r\nQA: and many more\n\nend  \n", "IBM\nAdobe Photoshop", " "]
PASTED_ENDS = ["https://www.linkedin.com/in/x", "Privacy Policy", "Python and sql, careers", "Don\u2019t want to see this", "Similar profiles", "Questions?\n", "\tCareers"]
MESSAGES = [" Ann added to the pool ", "Upload queued: cv.pdf", "", "Client saved", "Processing Upload: a.docx", "Resume upload (3 files)", "Job closed"]
SUBJECTS = ["", " Hello ", "Offer"]
CHAT_SCOPES = ["general", "Candidates ", "clients", "pool", ""]
ACTIONS = ["selected", "hire", "Not a fit", "shortlist", "rejection", "hired_x", "on hold", "dismissed", "Yes ", "hired interest", "!!", ""]
HEADS = ["Ann Lee\nE-mail: ann.lee@mail.org\nPhone +44 20 7946 0958", "Bo Chan | noreply@site.com\nbo . chan @ web.net", "Contact me: cy [at] host [dot] io", "Dee Ray\nwww.dee.dev", "Summary: 7+ years of experience in software at example.org\nmailto:e.f@corp.co.uk", "zed99gmail.com\n\nAbout me\nI enjoy building tools"]
BODIES = [
    "Work Experience\nBackend Engineer at Acme Inc\nJan 2015 - Mar 2018\n03/2017 - 06/2019\nSkills: python, sql",
    "EXPERIENCE\nDeveloper 2010 - 2014\nAnalyst 2012 to 2016\nEducation\nBachelor of Science, State University 2004 - 2008",
    "Engineer, Solutions Ltd, 2 0 0 5 - 2 0 0 9\nSchool 1999-2003",
    "Projects\nShop 2018 - 2020\nSkills\nreact, node\n\n12 endorsements",
    "Over 4 years at university. 13 years related to your experience with ads",
    "Certifications\nAWS Solutions Architect Associate\nCertified Scrum Master\n\nLanguages\nFrench",
    "Full-time manager at Bolt, 2016/02 - present relevant work experience Lead 2019 - 2020 Education MSc",
    "",
]
TAILS = ["\nMaster of Arts, MBA", "\n\nMay 2020 award of the faculty", "\nCISSP", "\nMatric, O-levels\n\nReferences on request", " ", "\nPMP credential\n5 years as a designer", "\nPh.D thesis"]
#: What stands before and behind a document in a résumé; {first} and {second} are words of the document, {f} and {s} the same by letters.
NAME_TOPS = [
    "Full Name: {first} {second}\nQA Engineer\n", "{first} {second} | Senior QA Engineer | +92 300 0000000\n", "{SECOND}, {FIRST}\nSoftware Engineer\n", "Time management\nDr. {first} {second} (she/her)\n",
    "{first} {second}  Email: {first}.{second}@mail.org\n", "{f}   {s}\nData Analyst\n", "Senior Software Engineer | {first} {second} | Karachi, Pakistan | x@mail.org\n", "", "Finance Analyst Name: {first} {second} | City: Lahore\n",
    "RESUME\n{first} {second} Lahore\n", "{first} {second} +92-317-4497371\n", "Certified {first} {second}\n", "Software Engineer\r\nPython, AWS\r\n\r\n",
]
NAME_TAILS = ["", "", "\nThis resume belongs to: \u2014 {second} {first} \u2014", "", "\nprepared by {first} and {second}\nend", "", ""]
NAME_MAILS = ["{first}.{second}@mail.org", "support@site.org", "{second}7+jobs@web.net", "", "{first}_{second}9@corp.co.uk", "{first}-data-analyst@x.org"]
NAME_FILES = ["{first}_{second}", "up/{first}_{second}_Resume.pdf", "{FIRST}-{SECOND}-final2.docx", "My_Resume", "{second} Finance.txt", "12_{first}_{second}"]
NAME_SLUGS = ["{first}-{second}-1a2b3c4d", "{first}-{second}", "{first}+{second}-abcdef12", "%C3%89lo-{second}-b12345"]
ADDRESS_TOPS = [
    "{first} {second}\n{first} {second} 22 g mail c o m\n", "{first} . {second} @ web . net\n", "", "{first} {second}\n{first}77@web\n.net\nSkills\nsql\n", "{first}\n{second}55\ngmail.com\nEducation\n", "{first} y a h o o . c o m | {SECOND}\n",
    "E-mail: {f} @ {second}.org\n", "{first} [at] {second} [dot] io\n", "no-reply@{first}.com\n", "Skills\n{first}7 outlook com {second}\n", "{first}{second}9gmail.com\n",
]
ADDRESS_TAILS = ["", "\nmailto:{second}@{first}.co.uk", "", "\n{first} i c l o u d . com", "\n{second}@\n  host.net"]
SCHOOL_TOPS = [
    "Education\nBachelor of {second}\n{first} University\n", "EDUCATION\n{first} University \u2014 BS {second} | 2022 \u2013 2026 |\u200b Technical Skills | \u25cf JavaScript\n", "",
    "Education\n{first} College, MSc\nGrade: pass\nJun 2010 - Nov 2012\nsports\nSkills\npython\n", "Engineer\n{first} School 2010\nx of {second} Institute, Projects: many\nMIT graduate\n",
    "Qualifications\nx oe University of {first} | 2010 | ab cd ef gh | {second}\nMaster of Arts \u2022 2014 \u2014 {second} degree\nAcademic\n", "Education\n{first} University ab c de fg hi\nDiploma / devops and more\nProjects\n",
    "Education\n{first} Academy\nMBA\n{second} School\nPhD\nBSc in {second}\nAwards\n", "Education\nMaster of {first} at the University 2012 technical skills python, react\n\n\u00b7 BSc 2010 \u00b7 \u25cf React\n",
]
SCHOOL_TAILS = ["", "\nEducation\n{second} Polytechnic, diploma", "\n{first} College 1999", " Education MSc", "\nLanguages\n{first} School of skills and arts"]
STATUSES = ["new", "screened", "shortlisted", "selected", "interviewing", "hired", "declined"]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW.isoformat(" ")).cast("timestamp")


def pick(values: list[str], number: Column) -> Column:
    """The value that a number falls on."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("workspace_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company_name"),
        F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("client_status"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("client_id"), pick(TITLES, F.col("o_orderkey")).alias("title"), pick(JOB_SKILLS, F.col("o_orderkey")).alias("skills"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "completed").otherwise("on_hold").alias("status"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").when(F.col("o_orderpriority").startswith("5"), "low").otherwise("").alias("urgency"),
        F.pmod("o_orderkey", F.lit(11)).cast("double").alias("min_experience"), pick(REQUIRED, F.col("o_orderkey")).alias("education_required"), F.col("o_orderdate").alias("created_at"), pick(DESCRIPTIONS, F.col("o_orderkey")).alias("description"),
    )
    return orders.join(clients(spark, sf_dir).select("client_id", "workspace_id"), "client_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return raw(spark, sf_dir, "part").select(
        key.alias("candidate_id"), F.col("p_name").alias("full_name"), pick(TITLES, key + F.floor(key / 6)).alias("title"), F.lower("p_type").alias("role_label"), pick(CANDIDATE_SKILLS, key).alias("skills"),
        F.col("p_size").cast("double").alias("years"), pick(DEGREES, key).alias("degree"), F.when(key % 3 == 0, "aws certified").otherwise("").alias("certifications"), pick(STATUSES, key).alias("status"),
        F.when(F.col("p_size") > 25, F.pmod(key, F.lit(25)).cast("int")).alias("workspace_id"), (now() - F.make_dt_interval(F.pmod(key, F.lit(400)).cast("int"))).alias("created_at"),
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications; a tenth of the candidates has none."""
    return raw(spark, sf_dir, "lineitem").where("l_partkey % 10 <> 0").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("candidate_id"), pick(STATUSES, F.col("l_partkey") + F.col("l_linenumber")).alias("status"), F.col("l_shipdate").alias("updated_at"))


def _ranked(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("candidate_id")).agg((F.max("l_discount") * 10).alias("score"), (F.max("l_tax") * 10).alias("similarity"), F.max("l_shipdate").alias("run_at"))


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each ranked pair: score and similarity in 0..1 and the last run."""
    return _ranked(raw(spark, sf_dir, "lineitem").where("l_discount > 0"))


def rankings_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt out by job before the grouping: what goes by job from there needs no other shuffle."""
    return _ranked(raw(spark, sf_dir, "lineitem").where("l_discount > 0").repartition("l_orderkey"))


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = raw(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("workspace_id"))
    lines = raw(spark, sf_dir, "lineitem").where("l_suppkey % 17 = 0").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("candidate_id"))
    return lines.join(suppliers, "s_suppkey").select("workspace_id", "candidate_id").distinct()


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), "user_id", F.pmod("user_id", F.lit(25)).cast("int").alias("workspace_id"), "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(raw(spark, sf_dir, "documents"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each candidate, put together from parts."""
    key = F.col("p_partkey")
    return spread(raw(spark, sf_dir, "part")).select(key.alias("candidate_id"), F.concat(pick(HEADS, key), F.lit("\n"), pick(BODIES, F.floor(key / 6)), pick(TAILS, key)).alias("text"))


def _filled(values: list[str], number: Column) -> Column:
    """The value that a number falls on, with the first two capitalised words of a text in it."""
    # Found by a search that ends at the second word, not in a list of all.
    word = "[A-Z][a-z]{2,}+"
    found = [F.regexp_extract("text", word, 0), F.regexp_extract("text", f"(?s){word}.*?({word})", 1)]
    first, second = (F.coalesce(F.nullif(x, F.lit("")), F.lit(w)) for x, w in zip(found, ["Ada", "Byron"], strict=True))
    spaced = lambda w: F.array_join(F.filter(F.split(w, ""), lambda x: x != ""), " ")
    out = pick(values, number)
    for mark, word in {"{first}": first, "{second}": second, "{FIRST}": F.upper(first), "{SECOND}": F.upper(second), "{f}": spaced(first), "{s}": spaced(second)}.items():
        out = F.replace(out, F.lit(mark), word)
    return out


def named_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a résumé with an address, a file's name and a profile link, made with words of its own."""
    key = F.col("doc_id")
    text = F.concat(_filled(NAME_TOPS, key), F.coalesce("text", F.lit("")), _filled(NAME_TAILS, F.floor(key / 13)))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"), F.lower(_filled(NAME_MAILS, F.floor(key / 5))).alias("email"), _filled(NAME_FILES, key).alias("file_name"), _filled(NAME_SLUGS, key).alias("slug"))


def addressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a scanned résumé with addresses made with words of its own."""
    key = F.col("doc_id")
    return documents(spark, sf_dir).select(key.alias("id"), F.concat(_filled(ADDRESS_TOPS, key), F.coalesce("text", F.lit("")), _filled(ADDRESS_TAILS, F.floor(key / 11))).alias("text"))


def schooled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a résumé with lines of education, made with words of its own."""
    key = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", F.concat(_filled(SCHOOL_TOPS, key), F.coalesce("text", F.lit("")), _filled(SCHOOL_TAILS, F.floor(key / 9))).alias("text"))


def inbox_now() -> Column:
    return F.lit(INBOX_NOW.isoformat(" ")).cast("timestamp")


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity log: errors are uploads, and every third entry has a link."""
    return activity(spark, sf_dir).select("event_id", F.when(F.col("kind") == "error", "upload").otherwise(F.col("kind")).alias("kind"), pick(MESSAGES, F.col("event_id")).alias("message"), F.when(F.col("event_id") % 3 == 0, " /pool ").alias("href"), "created_at", "workspace_id")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each applied pair, when the application last changed."""
    last = applicants(spark, sf_dir).groupBy("job_id", "candidate_id").agg(F.max("updated_at").alias("created_at"))
    return last.select((F.col("job_id") * 1000000 + F.col("candidate_id")).alias("feedback_id"), "job_id", "candidate_id", pick(ACTIONS, F.col("job_id") + F.col("candidate_id")).alias("action"), "created_at")


def _address(number: Column) -> Column:
    return F.concat(F.lit("user"), number.cast("string"), F.lit("@mail.org"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return raw(spark, sf_dir, "customer").select(key.alias("user_id"), F.initcap(_address(key)).alias("email"), F.when(key % 3 == 0, " ").otherwise(F.col("c_name")).alias("full_name"))


def client_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients share twenty addresses; the newest number came first."""
    key = F.col("client_id")
    name, firm = F.when(key % 4 == 0, "").otherwise(F.col("name")), F.when(key % 8 == 0, "").otherwise(F.col("company_name"))
    return clients(spark, sf_dir).select(key.alias("id"), _address(key % 20).alias("email"), (-key).alias("created_at"), F.array(name, firm).alias("names"))


def candidate_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("candidate_id")
    return candidates(spark, sf_dir).select(key.alias("id"), _address(key % 25).alias("email"), "created_at", F.array("full_name", "title").alias("names"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as messages between user 7 and others."""
    conv, turn, mine = F.col("conv_id"), F.col("turn"), F.col("role") != "user"
    other = F.pmod(conv, F.lit(30)) + 1
    return raw(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("message_id"), F.when(mine, 7).otherwise(other).alias("sender_id"), F.when(mine, other).otherwise(7).alias("recipient_id"), pick(SUBJECTS, conv + turn).alias("subject"), F.col("text").alias("body"),
        pick(CHAT_SCOPES, conv).alias("chat_scope"), F.timestamp_seconds(1704067200 + F.pmod(conv, F.lit(5000)) * 7200 + turn * 60).alias("created_at"), F.when(turn % 4 == 0, F.lit(1)).alias("read_at"), (conv % 7 == 0).alias("hidden_for_sender"), (conv % 5 == 0).alias("hidden_for_recipient"),
    )


def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile pages pasted with their menus, put together from parts."""
    key = F.col("p_partkey")
    return spread(raw(spark, sf_dir, "part")).select(key.alias("id"), F.concat(pick(PASTED_TOPS, key), F.lit("\n"), pick(PASTED_MIDDLES, F.floor(key / 7)), F.lit("\n"), pick(PASTED_ENDS, F.floor(key / 3))).alias("text"))


#: What an event says of an ingestion.
INGESTION_KINDS = {"view": "start", "click": "finish", "error": "error", "purchase": "retry", "signup": "submit"}
#: Uploads come in two batches, those of even numbers first; this lies between their times.
SECOND_BATCH = 10**12


def ingestion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as those of five ingestions."""
    kind = F.col("event_type")
    return raw(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") * 5 + F.col("event_id") % 5).alias("ingestion_id"), F.create_map(*[F.lit(x) for pair in INGESTION_KINDS.items() for x in pair])[kind].alias("kind"),
        F.when(kind == "error", F.concat(F.lit("no text in "), F.col("event_id").cast("string"))).otherwise("").alias("error"), F.col("ts").alias("created_at"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded texts; every third belongs to no workspace, every fourth brings no address."""
    key = F.col("doc_id")
    return documents(spark, sf_dir).select(
        key.alias("upload_id"), (key % 2 * SECOND_BATCH + key).alias("at"), F.col("text").alias("content"), F.concat(F.lit("Name "), key.cast("string")).alias("full_name"), pick(TITLES, key).alias("title"),
        F.when(key % 4 == 0, "").otherwise(_address(key)).alias("contact_email"), F.when(key % 3 != 0, key % 25).cast("int").alias("workspace_id"),
    )


def hidden_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces hid each candidate between the batches, or after them."""
    key = F.col("doc_id")
    external = F.concat(F.lit("u_"), F.substring(F.sha2("text", 256), 1, 14))
    return documents(spark, sf_dir).select((key % 25).cast("int").alias("workspace_id"), external.alias("external_id"), F.when(key % 5 == 0, 3 * SECOND_BATCH).otherwise(SECOND_BATCH).alias("at")).distinct()


#: Parts of skill lists that stand somewhere in a document's text.
SKILL_PARTS = [
    "Skills: Python, React.js (hooks) | c; go  \u2022 Node.js / end-to-end",
    "Senior python java SQL react docker aws kafka c++ stack",
    "python java sql and little more",
    "Tools: Don\u2019t want to see this, react, R, of, 12345, oracle, www.site.org",
    "We use asp.net, github-actions and user-friendly ci-cd; see host.com or fast.ai, C# and .NET",
    "testing :  selenium , jira-cloud , qa",
    "People also viewed\nAnn Lee\nACME!\nLanguages: Java, C",
    "",
]
SKILL_TOOLS = ["python", "java", "sql", "react", "docker", "aws", "kafka", "c++", "c#", "node.js", "github actions", "jira", "fast.ai"]
SKILL_SPELLINGS = {"jira-cloud": "jira", "golang": "go", "ci-cd": "kafka", "fast.ai": "fast.ai"}


def skill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a skill list put in somewhere between their words."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    at = F.pmod(key * 7919, F.length(text) + 1).cast("int")
    part = F.concat(F.lit("\n"), pick(SKILL_PARTS, key), F.lit("\n"))
    return documents(spark, sf_dir).select(key.alias("id"), F.concat(F.substring(text, F.lit(1), at), part, F.substring(text, at + 1, F.length(text))).alias("text"))


def skill_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs of the benchmark as phrases, most of them skills, some with another spelling; skills fall to domains by their length."""
    words = F.split(F.lower("text"), " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    found = raw(spark, sf_dir, "benchmark").select(words.alias("w")).where("size(w) > 1").select(F.explode(pairs).alias("form")).distinct()
    # Of such a pair the first word has an even and the second an odd number of letters, so no two overlap.
    found = found.where(F.col("form").rlike("^([a-z][a-z])+ [a-z]([a-z][a-z])*$"))
    other = F.replace("form", F.lit(" "), F.lit("_"))
    skill = F.when(F.length("form") % 5 == 0, other).otherwise(F.col("form"))
    kept = found.where(F.length("form") % 3 != 0).select(skill.alias("form"))
    fixed = spark.createDataFrame([("tool", t, None) for t in SKILL_TOOLS] + [("spelling", k, v) for k, v in SKILL_SPELLINGS.items()], "kind string, form string, value string")
    tools = fixed.where("kind = 'tool'").select("form").unionByName(kept)
    parts = [
        found.select(F.lit("phrase").alias("kind"), "form", F.lit(None).cast("string").alias("value")), found.where(F.length("form") % 5 == 0).select(F.lit("spelling").alias("kind"), "form", other.alias("value")),
        kept.select(F.lit("tool").alias("kind"), "form", F.lit(None).cast("string").alias("value")), tools.select(F.lit("domain").alias("kind"), "form", F.concat(F.lit("domain "), (F.length("form") % 4).cast("string")).alias("value")), fixed,
    ]
    return reduce(DataFrame.unionByName, parts)


#: How a row of a profile writes its dates: S and E stand for month and year of its start and end, A and B for the years.
DATE_FORMS = ["S \u2013 E", "A - B", "S - Present", "S,E\u2014E \u00b7 2 yrs 3 mos", "3 yrs 2 mos", "since A", "13 years related A-B", "", "E - S", "1 yr"]
SCHOOL_FORMS = ["  S-E", "A  \u2014 B", "S - present", "S \u2013 E"]
ROLES = ["Engineer", "Bachelor's degree", "PhD student", "Analyst", "Teacher"]
COMPANIES = ["Acme", "State University", "Polytechnic of Ulm", "Bolt Academy", "M.Sc. at the college"]


def _dated(form: Column) -> Column:
    """A form filled in for a line that begins when it ships and lasts as many months as it has pieces."""
    start, end = F.col("l_shipdate").cast("date"), F.add_months(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int"))
    filled = form
    for letter, value in {"S": F.date_format(start, "MMM yyyy"), "E": F.date_format(end, "MMMM yyyy"), "A": F.date_format(start, "yyyy"), "B": F.date_format(end, "yyyy")}.items():
        filled = F.regexp_replace(filled, F.lit(rf"\b{letter}\b"), value)
    return F.when(form == "", "").otherwise(filled)


def profile_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as the jobs in a person's profile."""
    key = F.col("l_partkey") + F.col("l_linenumber")
    return raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_linenumber").alias("row"), _dated(pick(DATE_FORMS, key)).alias("dates"), pick(ROLES, key).alias("role"), pick(COMPANIES, F.col("l_suppkey")).alias("company"))


def profile_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line again as a school, its dates written another way."""
    return raw(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("person"), _dated(pick(SCHOOL_FORMS, F.col("l_suppkey"))).alias("dates"))


def workspace_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings by another workspace, and for every third job also by its own, with a lower score."""
    own = jobs(spark, sf_dir).where("job_id % 3 = 0").select("job_id", "workspace_id")
    all_ = rankings(spark, sf_dir)
    other = all_.select("job_id", "candidate_id", "score", (100 + F.pmod("candidate_id", F.lit(5))).cast("int").alias("workspace_id"))
    return other.unionByName(all_.join(own, "job_id").select("job_id", "candidate_id", (F.col("score") / 2).alias("score"), F.col("workspace_id").cast("int").alias("workspace_id")))
