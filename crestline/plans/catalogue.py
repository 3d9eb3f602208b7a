"""The queries by name: operators over the domain's relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import dates
from crestline.functions import matching as names
from crestline.functions import names as nm
from crestline.functions import resume as cv
from crestline.functions import scoring, text
from crestline.operators import all_pairs, backfill, feeds, funnel, inbox, insight, lexical, listing, matching, profile_rows, ranking, refresh, reports, resume, retrieval, shortlisting, skill_mining, visibility
from crestline.operators import names as naming
from crestline.plans import bindings as b
from crestline.sources.scratch import scratch_path
from crestline.streaming import activity, ingestion
from crestline.streaming import uploads as up
from crestline.streaming.versions import Versions

Query = Callable[[SparkSession, str], DataFrame]
#: The workspace and the candidate that single-tenant queries ask about, and the page they show.
WORKSPACE, CANDIDATE, PAGE = 7, 11, 25
#: The job that a pool is ranked for.
RANKED_JOB = 2


def _relations(*names: str):
    """Passes the named relations to the query."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*[getattr(b, n)(spark, sf_dir) if hasattr(b, n) else b.raw(spark, sf_dir, n) for n in names])

    return wrap


def _pairs(applicants: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    return ranking.pair_scores(applicants, jobs, candidates)


@_relations("applicants", "candidates")
def funnel_global(applicants, candidates):
    return funnel.global_funnel(applicants, candidates, b.now())


@_relations("applicants", "candidates")
def funnel_per_job(applicants, candidates):
    return funnel.job_funnel(applicants, candidates, b.now())


@_relations("applicants", "candidates", "jobs")
def funnel_workspace(applicants, candidates, jobs):
    return funnel.workspace_funnel(applicants, candidates, jobs, b.now())


@_relations("applicants", "candidates")
def stage_preview(applicants, candidates):
    return funnel.stage_preview(applicants, candidates)


@_relations("candidates", "applicants", "rankings", "jobs", "hidden")
def candidate_visibility(candidates, applicants, rankings, jobs, hidden):
    return visibility.visible_candidates(candidates, [applicants, rankings], jobs, hidden)


@_relations("applicants", "jobs")
def hire_time(applicants, jobs):
    return reports.hire_time(applicants, jobs)


@_relations("applicants", "rankings", "jobs")
def report_kpis(applicants, rankings, jobs):
    return reports.report_kpis(applicants, rankings, jobs)


@_relations("rankings", "applicants", "jobs")
def report_job_performance(rankings, applicants, jobs):
    return reports.job_performance(rankings, applicants, jobs)


@_relations("applicants", "rankings", "jobs")
def ai_vs_manual(applicants, rankings, jobs):
    return reports.ai_vs_manual(applicants, rankings, jobs)


@_relations("clients", "jobs")
def client_active_jobs(clients, jobs):
    return reports.client_active_jobs(clients, jobs, WORKSPACE)


@_relations("jobs")
def job_status_pie(jobs):
    return reports.status_pie(jobs)


@_relations("jobs", "candidates", "applicants")
def dashboard_overview(jobs, candidates, applicants):
    return reports.dashboard(jobs, candidates, applicants, b.now())


@_relations("jobs", "clients")
def jobs_page_urgency(jobs, clients):
    return listing.jobs_page(jobs, clients, "engineer", 50, PAGE)


@_relations("candidates")
def candidates_page_search(candidates):
    return listing.candidates_page(candidates, "python", 25, PAGE)


@_relations("applicants", "rankings")
def applicant_list(applicants, rankings):
    return listing.applicant_list(applicants, rankings)


@_relations("applicants", "rankings")
def job_evaluations(applicants, rankings):
    return listing.job_evaluations(applicants, rankings)


@_relations("applicants", "jobs", "clients", "rankings")
def my_applications(applicants, jobs, clients, rankings):
    return listing.my_applications(applicants, jobs, clients, rankings, CANDIDATE)


@_relations("candidates")
def duplicate_contacts(candidates):
    return listing.duplicate_contacts(candidates, "candidate_id", F.concat(F.replace("full_name", F.lit(" "), F.lit(".")), F.lit("@"), F.col("role_label"), F.lit(".org")))


@_relations("rankings")
def latest_ranking_activity(rankings):
    return listing.latest_runs(rankings)


@_relations("candidates")
def profile_percentiles(candidates):
    return ranking.profile_scores(candidates)


@_relations("candidates", "rankings")
def competition_scores(candidates, rankings):
    return ranking.competition_scores(candidates, rankings)


@_relations("rankings", "applicants")
def best_job_per_candidate(rankings, applicants):
    return ranking.best_jobs(rankings, applicants)


@_relations("rankings")
def saved_rankings(rankings):
    return ranking.saved_rankings(rankings, 3)


@_relations("candidates", "clients", "rankings", "applicants", "jobs")
def compare_candidates(candidates, clients, rankings, applicants, jobs):
    """Six candidates side by side with their best job and its client."""
    best = ranking.best_jobs(rankings, applicants).join(jobs.select(F.col("job_id").alias("best_job_id"), F.col("title").alias("job_title"), "client_id"), "best_job_id").join(clients.select("client_id", F.col("name").alias("client_name")), "client_id")
    some = candidates.where(F.col("candidate_id").isin(1, 2, 3, 4, 5, 6)).select("candidate_id", "full_name", "years", "degree")
    return some.join(best.drop("client_id"), "candidate_id", "left")


@_relations("applicants", "jobs", "candidates")
def pair_weak_scores(applicants, jobs, candidates):
    return _pairs(applicants, jobs, candidates).select("job_id", "candidate_id", *[F.bround(c, 4).alias(c) for c in ("skill", "exp", "edu", "weak")])


@_relations("rankings", "jobs", "candidates")
def adjusted_scores(rankings, jobs, candidates):
    """The adjusted match of each ranked pair and its label."""
    s = ranking.pair_scores(rankings, jobs, candidates).select("job_id", "candidate_id", "skill", "band").join(rankings, ["job_id", "candidate_id"])
    final = scoring.adjusted_match(F.col("score"), F.col("similarity"), F.col("skill"), F.col("band"))
    blend = scoring.final_score(F.col("similarity"), F.col("skill"), F.col("band"))
    return s.select("job_id", "candidate_id", F.bround(final, 4).alias("final"), F.bround(blend, 4).alias("blend"), scoring.match_label(F.bround(100 * final, 4)).alias("label"))


@_relations("rankings", "jobs", "candidates")
def ranking_explanations(rankings, jobs, candidates):
    listed = {c: F.array_join(c, "|") for c in ("missing_skills", "missing_critical_skills")}
    return ranking.explanations(rankings, jobs, candidates).withColumns(listed)


@_relations("rankings", "applicants", "jobs", "candidates")
def top_candidate_insight(rankings, applicants, jobs, candidates):
    """Among a job's shortlisted candidates where it has any, else among all."""
    pool = insight.still_shortlisted(rankings, applicants.where("status = 'shortlisted'"))
    return insight.top_insight(pool, jobs, candidates).withColumn("insight", F.md5("insight"))


@_relations("rankings", "applicants")
def insight_keys(rankings, applicants):
    return insight.insight_keys(insight.still_shortlisted(rankings, applicants.where("status = 'shortlisted'")))


@_relations("rankings", "jobs", "candidates")
def smart_filter_pool(rankings, jobs, candidates):
    """Ranked pairs that pass similarity, skill overlap and role, counted by job and role."""
    pairs = rankings.where("similarity >= 0.05")
    scored = ranking.pair_scores(pairs, jobs, candidates).select("job_id", "candidate_id", "skill").where("skill >= 0.2")
    titled = scored.join(jobs.select("job_id", text.role_bucket(F.col("title")).alias("bucket")), "job_id").join(candidates.select("candidate_id", "title", "role_label"), "candidate_id")
    kept = titled.where(text.matches_role(F.col("bucket"), F.col("title"), F.col("role_label")))
    return kept.groupBy("job_id", "bucket").agg(F.count(F.lit(1)).alias("kept"), F.bround(F.avg("skill"), 4).alias("avg_skill"))


@_relations("rankings", "applicants")
def shortlist_compose(rankings, applicants):
    return ranking.shortlist(rankings, applicants, 0.2, 2)


@_relations("rankings", "applicants", "jobs", "candidates")
def final_ensemble(rankings, applicants, jobs, candidates):
    return ranking.ensemble(rankings, _pairs(applicants, jobs, candidates), candidates)


@_relations("rankings")
def hypothetical_rank(rankings):
    return ranking.hypothetical_rank(rankings, [0.25, 0.5, 0.75])


@_relations("rankings")
def ranking_metrics(rankings):
    df = rankings.select(F.col("candidate_id").alias("query"), F.col("job_id").alias("item"), F.col("score").alias("truth"), F.col("similarity").alias("predicted"))
    return ranking.ranking_metrics(df)


@_relations("rankings")
def classification_report(rankings):
    band = lambda c: F.floor(F.least(F.col(c), F.lit(0.99)) * 3).cast("int")
    return ranking.classification_report(rankings.select(band("score").alias("truth"), band("similarity").alias("predicted")))


@_relations("rankings")
def regression_metrics(rankings):
    return ranking.regression_metrics(rankings.select(F.col("score").alias("truth"), F.col("similarity").alias("predicted")))


def _banded(rankings: DataFrame) -> DataFrame:
    band = lambda c: F.floor(F.least(F.col(c), F.lit(0.99)) * 3).cast("int")
    return rankings.select(band("score").alias("truth"), band("similarity").alias("predicted"))


@_relations("rankings")
def classification_summary(rankings):
    return ranking.classification_summary(_banded(rankings))


@_relations("rankings")
def confusion_matrix(rankings):
    return ranking.confusion_matrix(_banded(rankings))


@_relations("rankings")
def rank_correlation(rankings):
    return ranking.spearman(rankings.select(F.col("score").alias("truth"), F.col("similarity").alias("predicted")))


@_relations("labels")
def feedback_labels_latest(labels):
    """Labels as feedback; every other document has a later event that takes it back."""
    first = labels.select((F.col("doc_id") % 40).alias("job_id"), F.col("doc_id").alias("candidate_id"), b.pick(b.ACTIONS, F.col("doc_id")).alias("action"), F.col("doc_id").alias("created_at"))
    later = first.where("candidate_id % 2 = 0").select("job_id", "candidate_id", F.lit("not_a_fit").alias("action"), (F.col("created_at") + 1000000).alias("created_at"))
    return feeds.latest_feedback(first.unionByName(later))


@_relations("labels")
def feedback_status(labels):
    return labels.select("doc_id", feeds.feedback_status(b.pick(b.ACTIONS, F.col("doc_id"))).alias("status"))


@_relations("jobs")
def jobs_filtered(jobs):
    return listing.jobs_filtered(jobs, " Inactive ", "1995-03-01", "1996-06-30T23:59:59").select("job_id", "status", "title")


@_relations("jobs")
def job_requirements(jobs):
    return jobs.select("job_id", text.years_asked(F.col("description")).alias("min_years"), text.degree_asked(F.col("description")).alias("degree"))


@_relations("candidates")
def role_fine(candidates):
    return candidates.select("candidate_id", text.role_fine(F.col("title"), F.col("skills"), F.col("role_label")).alias("role"), text.title_from_skills(F.col("skills")).alias("title_from_skills"))


@_relations("rankings", "jobs", "candidates")
def smart_filter_pairs(rankings, jobs, candidates):
    return matching.smart_filter(rankings, jobs, candidates, 0.05, 0.2).withColumn("overlap", F.bround("overlap", 4))


@_relations("rankings")
def low_match_warnings(rankings):
    return matching.low_matches(rankings, 0.4)


@_relations("candidates")
def role_labels(candidates):
    label = names.role_label(F.col("title"))
    return candidates.select("candidate_id", label.alias("label"), names.role_label(F.col("title"), names.ENGINEERING_LABELS, "fullstack").alias("engineering_label"))


@_relations("jobs")
def job_department(jobs):
    return jobs.select("job_id", names.department(F.col("title"), F.col("description")).alias("department"))


@_relations("skill_texts")
def core_skills(documents):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,}"), F.lit(0)))
    return documents.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq")).where(names.core_skill(F.col("word")))


@_relations("candidates")
def clean_titles(candidates):
    """Titles with a firm, a sentence or a sign behind them."""
    added = b.pick([" @ Acme Solutions Ltd", "", ", seeking work", " – II"], F.col("candidate_id"))
    return candidates.select("candidate_id", names.clean_title(F.concat("title", added)).alias("title"))


@_relations("candidates")
def profile_fallback(candidates):
    score = names.fallback_score(F.col("years"), F.col("skills"), F.col("degree"), F.col("certifications"))
    return candidates.select("candidate_id", names.experience_bucket(F.col("years")).alias("bucket"), score.alias("score"))


@_relations("resumes")
def resume_certifications(resumes):
    lined = resumes.select("candidate_id", "text", cv.lines(F.col("text")).alias("lines"))
    return lined.select("candidate_id", cv.highest_degree(F.col("text")).alias("degree"), cv.certifications(F.col("lines")).alias("certifications"))


@_relations("resumes")
def chunk_roles(resumes):
    cut = resumes.select("candidate_id", F.posexplode(cv.chunks(F.col("text"))).alias("place", "chunk"))
    return cut.select("candidate_id", (F.col("place") + 1).alias("place"), cv.chunk_role(F.col("chunk")).alias("role"))


@_relations("resumes")
def pii_keep_lines(resumes):
    return resumes.select("candidate_id", cv.strip_pii_lines(F.col("text")).alias("clean"))


@_relations("resumes")
def email_extract(resumes):
    return resume.primary_email(resumes.withColumnRenamed("candidate_id", "id"))


@_relations("addressed_texts")
def scanned_addresses(texts):
    return resume.primary_email(texts).select(F.col("id").alias("doc_id"), "email")


@_relations("resumes")
def years_experience(resumes):
    return resume.years_experience(resumes.withColumnRenamed("candidate_id", "id"), b.NOW.year + 20)


@_relations("pasted")
def page_chrome_filter(pasted):
    return resume.without_page_chrome(pasted)


@_relations("documents")
def document_skills(documents):
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    found = retrieval.known_words(texts, retrieval.vocabulary(documents, 12, 4000), 80)
    return found.select(F.col("id").alias("doc_id"), F.array_join("words", "|").alias("skills"))


@_relations("documents")
def resume_text(documents):
    return documents.select("doc_id", F.md5(text.resume_text(text.mended(F.col("text")))).alias("clean_md5"))


@_relations("candidates")
def pool_rank(candidates):
    texts = candidates.where(F.col("workspace_id") == WORKSPACE).select("candidate_id", "created_at", "years", F.concat_ws(" ", "full_name", "title", "skills").alias("text"))
    return ranking.pool_rank(texts, F.col("years") / 50, 0.75, 60)


@_relations("applicants")
def split_leakfree(applicants):
    return ranking.split_by_id(applicants, "candidate_id").groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("candidate_id").alias("people"))


@_relations("documents")
def split_stratified(documents):
    return ranking.split_stratified(documents.select("doc_id", "lang"), "doc_id", "lang").groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@_relations("benchmark", "documents")
def tfidf_top_k(benchmark, documents):
    return lexical.tfidf_top_k(benchmark.select(F.col("item_id").alias("id"), "text"), documents.select(F.col("doc_id").alias("id"), "text"), 5)


@_relations("benchmark", "documents")
def tfidf_common_terms(benchmark, documents):
    """The same by the prefilter's weights: the commonest terms, however many texts hold them."""
    return lexical.tfidf_top_k(benchmark.select(F.col("item_id").alias("id"), "text"), documents.select(F.col("doc_id").alias("id"), "text"), 10, 1, 1.0, lexical.PREFILTER_TERMS)


@_relations("jobs", "candidates", "documents")
def ranked_pool(jobs, candidates, documents):
    """The first 50 of all candidates for a job: the 200 nearest by text, scored."""
    described = jobs.withColumn("text", F.concat_ws(" ", "title", "skills", "description"))
    written = candidates.join(documents.select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("resume")), "candidate_id", "left")
    return lexical.rank_pool(described, RANKED_JOB, written.withColumn("text", F.concat_ws(" ", "full_name", "title", "skills", "resume")), 200, 50)


@_relations("embeddings")
def cosine_top_k(embeddings):
    return retrieval.cosine_top_k(embeddings, 100, 5)


@_relations("documents")
def skill_vocab(documents):
    return retrieval.vocabulary(documents, 12, 4000)


@_relations("documents")
def ngram_discovery(documents):
    return retrieval.common_ngrams(documents, {2: 600, 3: 400})


@_relations("documents")
def pii_strip(documents):
    return documents.select("doc_id", F.md5(text.strip_pii(F.col("text"))).alias("clean_md5"))


@_relations("documents")
def pii_audit(documents):
    return documents.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.count_if(text.contains_pii(F.col("text"))).alias("with_pii"))


@_relations("lineitem")
def interval_union_years(lineitem):
    """Spans of years by part, overlaps counted once."""
    start = F.year("l_shipdate")
    return feeds.interval_years(lineitem.select(F.col("l_partkey").alias("key"), start.alias("start"), (start + F.pmod("l_linenumber", F.lit(3))).alias("end")))


@_relations("conversations")
def inbox_threads(conversations):
    return feeds.threads(conversations)


@_relations("activity")
def ingestion_rollup(events):
    status = F.when(F.col("kind").isin("signup", "click"), "queued").when(F.col("kind") == "view", "processing").when(F.col("kind") == "purchase", "done").otherwise("failed")
    queue = events.select(F.to_date("created_at").cast("string").alias("batch_id"), status.alias("status"), F.col("created_at").alias("updated_at"))
    return feeds.ingestion_rollup(queue, F.lit("2024-01-30 12:00:00").cast("timestamp"))


@_relations("logged", "jobs", "rankings", "feedback", "candidates")
def activity_feed(logged, jobs, rankings, feedback, candidates):
    return inbox.notifications(logged, jobs, rankings, feedback, candidates, WORKSPACE, b.inbox_now())


@_relations("logged", "jobs", "rankings", "feedback", "candidates", "messages", "client_contacts", "candidate_contacts", "users")
def inbox_rows(logged, jobs, rankings, feedback, candidates, messages, client_contacts, candidate_contacts, users):
    """Every other event has been read."""
    read = logged.where("event_id % 2 = 0").select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("item_key"))
    activity = inbox.notifications(logged, jobs, rankings, feedback, candidates, WORKSPACE, b.inbox_now())
    rows = inbox.inbox(activity, read, messages, client_contacts, candidate_contacts, users, WORKSPACE)
    return rows.withColumns({f"in_{tab}": F.coalesce(inbox.in_tab(tab), F.lit(False)) for tab in ("alerts", "candidates")})


@_relations("candidates", "applicants", "rankings", "jobs")
def workspace_backfill(candidates, applicants, rankings, jobs):
    return backfill.workspace_backfill(candidates, [applicants.where("status = 'hired'"), rankings, applicants], jobs)


@_relations("rankings", "jobs")
def workspace_best_jobs(rankings, jobs):
    return backfill.workspace_best_jobs(rankings, jobs, WORKSPACE)


@_relations("rankings", "applicants")
def best_job_changes(rankings, applicants):
    """Of the stored values a third is as computed, a third a little off, and the rest has another job or is missing."""
    best, key = ranking.best_jobs(rankings, applicants), F.col("candidate_id")
    stored = best.where(key % 7 != 0).withColumns({"best_score": F.col("best_score") + F.when(key % 3 == 1, 0.5).when(key % 3 == 2, 0.001).otherwise(0.0), "best_job_id": F.col("best_job_id") + (key % 5 == 0).cast("int")})
    return backfill.changed_best(best, stored)


@_relations("feedback", "rankings", "jobs", "candidates")
def feedback_export(feedback, rankings, jobs, candidates):
    """Every ninth candidate is gone."""
    noted = feedback.withColumn("notes", b.pick(b.BODIES, F.col("feedback_id"))).join(rankings.select("job_id", "candidate_id", F.bround("score", 4).alias("score")), ["job_id", "candidate_id"], "left")
    return backfill.feedback_export(noted, jobs, candidates.where("candidate_id % 9 <> 0"))


@_relations("rankings")
def pairs_sample(rankings):
    return backfill.sample_by_group(rankings.select("job_id", "candidate_id"), "candidate_id", "job_id", 3)


@_relations("jobs", "clients", "applicants")
def job_board(jobs, clients, applicants):
    return backfill.job_board(jobs, clients, applicants, CANDIDATE, "engineer", 0, 50)


@_relations("activity")
def stream_activity_windows(events):
    return activity.windowed_counts(events)


@_relations("profile_jobs", "profile_schools")
def jobs_alone(jobs, schools):
    """Rows of jobs that are no school's by their dates, how long they lasted, and whether they read as a school's."""
    kept = profile_rows.jobs_alone(jobs, schools, b.now())
    return kept.select("person", "row", dates.months(F.col("dates"), b.now()).alias("months"), dates.is_study(F.col("role"), F.col("company"), F.lit("")).alias("is_study"))


@_relations("rankings", "jobs", "candidates", "applicants")
def shortlist_refresh(rankings, jobs, candidates, applicants):
    """Each job's two best that pass the filter and its applicants, with the counters of the whole refresh on each row."""
    pairs = rankings.withColumn("similarity", F.when(F.col("candidate_id") % 11 != 0, F.col("similarity")))
    found, counts = shortlisting.refreshed_shortlist(pairs, jobs, candidates, applicants, 0.05, 0.2, 2)
    return found.select("job_id", "place", "candidate_id", F.bround("similarity", 4).alias("similarity"), "forced", *[F.lit(n).alias(f"n_{c}") for c, n in counts.items()])


@_relations("applicants", "candidates", "rankings")
def shortlist_changes(applicants, candidates, rankings):
    """Applications after the best ranked are shortlisted and every fifth pair is taken off."""
    pairs = applicants.groupBy("job_id", "candidate_id").agg(F.max("status").alias("status"))
    listed = pairs.where("status = 'shortlisted'")
    _, after, _ = shortlisting.changed_shortlist(listed, pairs, candidates, rankings.where("score >= 0.9"), listed.where("(job_id + candidate_id) % 5 = 0"))
    return after


@_relations("candidates", "rankings")
def pool_shown(candidates, rankings):
    """The best forty engineers of the public pool by match, of the rankings of all jobs."""
    best = rankings.groupBy("candidate_id").agg(F.max("score").alias("score"), F.max("similarity").alias("similarity"), F.min("job_id").alias("rank"))
    pool = candidates.select("candidate_id", F.col("full_name").alias("name"), "title", F.col("role_label").alias("role"), "skills", F.col("workspace_id").isNull().alias("is_public")).join(best.select("candidate_id", "similarity"), "candidate_id", "left")
    shown = shortlisting.shown_pool(pool, best, "match_desc", 40, "Engineer ", 60, "public")
    return shown.select("place", "candidate_id", F.bround("score", 4).alias("score"))


@_relations("applicants", "jobs", "clients", "workspace_rankings")
def application_scores(applicants, jobs, clients, rankings):
    return listing.application_scores(applicants, jobs, clients, rankings).groupBy("job_id", "candidate_id", "title", "company", "match_score", "own_ranking").agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status"))


@_relations("skill_texts", "skill_lexicon")
def mined_skills(texts, lexicon):
    found = skill_mining.mined_skills(texts, lexicon)
    return found.select(F.col("id").alias("doc_id"), *[F.array_join(c, "|").alias(c) for c in ("skills", "domains")])


@_relations("jobs", "candidates")
def best_candidates(jobs, candidates):
    """The five best of all candidates for each job."""
    return all_pairs.best_candidates(jobs, candidates, 5).select("job_id", "place", "candidate_id", *[F.bround(c, 4).alias(c) for c in ("skill", "exp", "edu", "weak")])


@_relations("jobs", "candidates")
def mean_job_scores(jobs, candidates):
    return all_pairs.mean_scores(jobs, candidates)


@_relations("ingestion_events")
def ingestion_states(events):
    return ingestion.states(events, F.lit("2024-01-30 23:00:00").cast("timestamp"))


@_relations("uploads")
def candidate_upserts(uploads):
    """All uploads in two batches, the first of which comes again after both."""
    spark = uploads.sparkSession
    table = Versions(spark, scratch_path(spark, "candidates"), up.CANDIDATES, "external_id", up.upserted, buckets=8)
    batches = [uploads.where(F.col("at") < b.SECOND_BATCH), uploads.where(F.col("at") >= b.SECOND_BATCH)]
    for number in (0, 1, 0):
        table.apply(up.identified(batches[number]), number)
    return table.rows()


@_relations("hidden_uploads", "uploads")
def hidden_candidates(hidden, uploads):
    return up.still_hidden(hidden, uploads)


@_relations("rankings_by_job", "jobs", "candidates")
def refreshed_rankings(rankings, jobs, candidates):
    """Rankings as saved before the newest runs and some changes of jobs and candidates, then refreshed where these matter."""
    spark = rankings.sparkSession
    old_jobs = jobs.withColumn("min_experience", F.col("min_experience") + (F.col("job_id") % 50 == 0).cast("int"))
    old_candidates = candidates.withColumn("years", F.col("years") + (F.col("candidate_id") % 40 == 0).cast("int"))
    old_rankings = rankings.where("run_at < timestamp'1998-01-01'")
    saved = refresh.SavedRankings(spark, scratch_path(spark, "saved"))
    saved.write(old_rankings, old_jobs, old_candidates)
    gone = [refresh.changed(old_jobs, jobs, ["job_id"]), refresh.changed(old_candidates, candidates, ["candidate_id"]), refresh.changed(old_rankings, rankings, ["job_id", "candidate_id"])]
    saved.refresh(refresh.affected_jobs(rankings, *gone), rankings, jobs, candidates)
    return saved.rows()


@_relations("named_texts")
def resume_names(texts):
    return naming.resolved_names(texts).select("doc_id", "name", "name_source")


@_relations("named_texts")
def file_names(texts):
    shown = nm.from_file_name(F.col("file_name"))
    return texts.select("doc_id", shown.alias("shown"), nm.from_file_stem(F.regexp_replace(F.regexp_replace("file_name", "^.*/", ""), r"\.[^.]+$", "")).alias("name"), nm.from_profile_slug(F.col("slug")).alias("profile_name"))


@_relations("schooled_texts")
def education_lines(texts):
    return resume.education(texts).select("doc_id", "education")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if callable(f) and getattr(f, "__qualname__", "").startswith("_relations.")}
