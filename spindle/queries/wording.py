"""Text cleaning, answer reading, prompts and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import answers, prompts, text, tokens
from spindle.functions.clean import clean_caption
from spindle.operators import records
from spindle.queries.registry import Tables, query
from spindle.ship import spread

@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), '_', ' '), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')) AS canonical FROM documents""")
def q_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", text.canonical(F.col("text")).alias("canonical"))


@query(f"""WITH a AS (SELECT doc_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}', ' ', 'g'), '#\\d{{1,3}}\\b', '', 'g'), '\\b\\d{{6,}}\\b', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\\.]{{2,}}', ' ', 'g'), '[#&)(\\]\\[}}{{|\\\\/*~]+', ' ', 'g') AS t FROM b)
SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\\s+\\.\\s+', ' ', 'g'), '\\s+', ' ', 'g')) AS caption FROM c""")
def q_clean_caption_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ((r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", " "), (r"#\d{1,3}\b", ""), (r"\b\d{6,}\b", ""), (r"[\.]{2,}", " "), (r"[#&)(\]\[}{|\\/*~]+", " "), (r"\s+\.\s+", " "), (r"\s+", " "))
    return Tables(spark, sf_dir).documents.select("doc_id", F.trim(text.substituted(F.lower(text.strip(F.col("text"))), steps)).alias("caption"))


@query()
def q_clean_caption_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(Tables(spark, sf_dir).pages.select("page_id", "html")).select("page_id", clean_caption(F.col("html")).alias("caption"))


_SAID = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("SELECT doc_id, CASE WHEN lower(text) IN ('yes', 'no') THEN lower(text) WHEN contains(substr(lower(text), 1, 4), 'yes') THEN 'yes' WHEN contains(substr(lower(text), 1, 4), 'no') THEN 'no' ELSE 'other' END AS parsed FROM documents")
def q_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", answers.yes_no(F.col("text")).alias("parsed"))


_MIXED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || '不是' WHEN 2 THEN 'True, 是的' || text ELSE '否 False ' || text END"


@query(f"""WITH m AS (SELECT doc_id, {_MIXED} AS m FROM documents),
t AS (SELECT doc_id, m, replace(replace(regexp_replace(replace(replace(m, chr(10), ''), 'True', 'Yes'), '^\\s+|\\s+$', '', 'g'), 'False', 'No'), '不是', 'No') AS t FROM m)
SELECT doc_id, regexp_replace(replace(replace(t, '是', 'Yes'), '否', 'No'), '[\u4e00-\u9fa5]', '', 'g') AS translated, list_has_any(string_split(replace(split_part(m, '.', 1), ',', ''), ' '), ['No', 'not', 'no']) AS says_no FROM t""")
def q_translate_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    said = F.when(n == 0, F.col("text")).when(n == 1, F.concat("text", F.lit("不是"))).when(n == 2, F.concat(F.lit("True, 是的"), "text")).otherwise(F.concat(F.lit("否 False "), "text"))
    return Tables(spark, sf_dir).documents.select("doc_id", answers.translated(said).alias("translated"), answers.first_sentence_no(said).alias("says_no"))


_FIRST = "regexp_extract(text, '^[^\\n]*')"


@query(f"SELECT doc_id, regexp_replace({_FIRST}, '^\\s+|\\s+$', '', 'g') AS answer FROM documents")
def q_answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("I think so.\nfinal ANSWER:  "), F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", answers.final_answer(said).alias("answer"))


@query("SELECT doc_id, CAST(doc_id % 3 AS DOUBLE) AS consistency, CAST(9.9 AS DOUBLE) AS realism FROM documents")
def q_score_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("**Consistency**: 1\nText. consistency："), (F.col("doc_id") % 3).cast("string"))
    return Tables(spark, sf_dir).documents.select("doc_id", answers.judge_score(said, "Consistency").alias("consistency"), answers.judge_score(said, "Realism").alias("realism"))


@query(f"WITH t AS (SELECT doc_id, {_SAID} AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 'C' WHEN t IN ('A', 'B', 'C', 'D') THEN t WHEN contains(t, 'A') THEN 'A' WHEN contains(t, 'B') THEN 'B' WHEN contains(t, 'C') THEN 'C' WHEN contains(t, 'D') THEN 'D' ELSE t END AS letter FROM t")
def q_mc_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", answers.choice_letter(F.col("text"), 4, "C").alias("letter"))


@query("SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'C. ' || p_name ELSE '' END AS options FROM part")
def q_option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array("p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")))
    return Tables(spark, sf_dir).part.select("p_partkey", answers.lettered(options).alias("options"))


@query("SELECT p_partkey, list_element(['B', 'A', 'C', NULL], CAST(p_size % 4 AS BIGINT) + 1) AS letter FROM part")
def q_parse_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(F.lit("first (A) but then (B)."), F.lit("it is A"), F.lit("The answer must surely be blue paint here"), F.lit("no idea")), F.col("p_size") % 4)
    return Tables(spark, sf_dir).part.select("p_partkey", answers.parsed_choice(said, F.array(F.lit("red"), F.lit("green"), F.lit("Blue paint"))).alias("letter"))


@query()
def q_parse_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Let x be 3. So the result is "), F.col("p_size").cast("string"), F.lit("\nx = "), (F.col("p_retailprice")).cast("string"))
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_size", answers.parsed_open(said).alias("forms"))
    return p.select("p_partkey", F.array_join("forms", "|").alias("forms"), answers.open_correct(F.array(F.col("p_size").cast("string")), F.col("forms")).alias("correct"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN 'x' ELSE p_brand END AS answer FROM part")
def q_normalise_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "integer").otherwise("text")
    said = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit(".7"))).when(F.col("p_size") % 3 == 1, "x").otherwise("(a) is right")
    question = F.when(F.col("p_size") % 3 == 2, "multi_choice").otherwise("free_form")
    return Tables(spark, sf_dir).part.select("p_partkey", answers.normal_extraction(said, F.array("p_brand", "p_type"), question, kind, F.lit(2)).alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 4 = 1 THEN p_brand END AS answer FROM part")
def q_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 4
    said = F.when(n == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(n == 1, F.col("p_brand")).otherwise("about nine")
    return Tables(spark, sf_dir).part.select("p_partkey", answers.rule_extraction(said, F.array("p_brand", "p_type"), F.when(n == 1, "multi_choice").otherwise("free_form"), F.when(n == 0, "integer").otherwise("float")).alias("answer"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]') AS digits, regexp_matches(text, '\\b(more|less|total|sum|max|min|mean|rate|cone|most|least)\\b') AS quantity FROM documents")
def q_word_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", answers.has_digit(F.col("text")).alias("digits"), answers.has_quantity_word(F.col("text")).alias("quantity"))


_PRICE = "CASE l_partkey % 3 WHEN 0 THEN CAST(l_extendedprice AS VARCHAR) WHEN 1 THEN CAST(l_quantity AS VARCHAR) ELSE l_returnflag || CAST(l_suppkey AS VARCHAR) END"


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_PRICE} AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, regexp_full_match(regexp_replace(t, '\\.0+$', ''), '[+-]?[0-9]+') AS digits, contains(t, '.') AND TRY_CAST(t AS DOUBLE) IS NOT NULL AS floats FROM t")
def q_number_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_partkey") % 3
    said = F.when(n == 0, F.col("l_extendedprice").cast("string")).when(n == 1, F.col("l_quantity").cast("string")).otherwise(F.concat("l_returnflag", F.col("l_suppkey").cast("string")))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", answers.is_digit_string(said).alias("digits"), answers.is_float_string(said).alias("floats"))


@query()
def q_normal_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("The "), F.col("p_name"), F.lit(", isnt it? two 1,000 u.s. "))
    return spread(Tables(spark, sf_dir).part.select("p_partkey", "p_name")).select("p_partkey", text.normal_answer(said).alias("answer"))


@query("SELECT n_nationkey, CASE WHEN regexp_matches(lower(n_name), '^[aeiou]') THEN 'an ' ELSE 'a ' END || lower(n_name) AS one, lower(n_name) || CASE WHEN ends_with(lower(n_name), 's') THEN 'es' ELSE 's' END AS many FROM nation")
def q_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).nation.select("n_nationkey", text.with_article(F.lower("n_name")).alias("one"), text.plural(F.lower("n_name")).alias("many"))


@query()
def q_prompt_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.suite(spark, ["person", "cat", "apple", "bus", "clock"], 100, 43).select("tag", "idx", "prompt", F.size("include").alias("rules"), F.size("exclude").alias("excluded"))


@query("SELECT c_custkey, 'Question: ' || c_name || ' in ' || c_mktsegment || '?' || chr(10) || 'Answer: ' AS prompt FROM customer")
def q_prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).customer.select("c_custkey", prompts.filled("Question: {a} in {b}?\nAnswer: ", a=F.col("c_name"), b=F.col("c_mktsegment")).alias("prompt"))


@query("SELECT s_suppkey, 'Hint' || chr(10) || s_name || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'Pick one.' AS prompt, s_suppkey % 2 = 0 AS valid FROM supplier")
def q_option_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts.option_question(F.col("s_name"), F.array(F.lit("yes"), F.lit("no")), F.lit("Hint"), "Pick one.")
    return Tables(spark, sf_dir).supplier.select("s_suppkey", p.alias("prompt"), prompts.is_extracted(F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise("\t ")).alias("valid"))


@query("""WITH k AS (SELECT text FROM benchmark ORDER BY CAST('0x' || substr(md5(concat_ws(':', '8', 'few-shot', text)), 1, 8) AS BIGINT), text LIMIT 3)
SELECT n_nationkey, (SELECT string_agg(text, chr(10) ORDER BY text) FROM k) AS shots FROM nation""")
def q_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    r = records.few_shot(t.nation, t.benchmark, "n_nationkey", "text", 3, 8)
    return r.select("n_nationkey", F.array_join("examples", "\n").alias("shots"))


@query()
def q_tokenise_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, merges = tokens.learned_merges({"the": 9, " the": 9, " of": 5, " and": 5, "tion": 7, " in": 4}, 12)
    said = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|>"))
    bpe = tokens.Bpe(tokens.with_special(vocabulary), merges)
    docs = tokens.encoded(Tables(spark, sf_dir).documents.select("doc_id", said.alias("said")), "said", bpe)
    return docs.select("doc_id", F.size(tokens.pre_tokens(F.col("said"), bpe.special)).alias("pieces"), F.size("ids").alias("n_ids"), F.element_at(tokens.with_eos(F.col("ids"), 300), -1).alias("final"))
