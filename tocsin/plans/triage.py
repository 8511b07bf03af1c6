"""The whole job: requests and answers in, reports and dead letters out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.operators import prompts
from tocsin.operators.agents import Model, ask_once, worth_another
from tocsin.operators.answers import ATTEMPTS, CHAIN, agent_chains, chain_usage, read_answers, unavailable
from tocsin.operators.governance import Rules
from tocsin.operators.logs import preprocess_dumps
from tocsin.operators.reports import all_reports, has_anchor, request_key
from tocsin.operators.validation import accepted, with_default_window


# What later prompts quote of earlier answers, in the order of the last prompt.
QUOTED = {
    "agent_severity": "severity.severity_detected",
    "root_cause": "diagnostic.root_cause",
    "explanation": "diagnostic.explanation",
    "command": "remediation.remediation_command",
}


def incidents_of(requests: DataFrame) -> DataFrame:
    """Accepted requests after the log stage, one row each, payload dropped."""
    valid = accepted(with_default_window(requests))
    return preprocess_dumps(valid, F.col("max_context_lines")).withColumn(
        "incident_key", request_key()
    )


def intake_of(requests: DataFrame) -> DataFrame:
    """Checked requests, rejected ones too, after the log stage; of rejected payloads size and digest are left."""
    good, payload = F.size("errors") == 0, F.col("log_payload")
    sized = requests.withColumns(
        {
            "payload_bytes": F.when(~good, F.octet_length(payload).cast("bigint")),
            "payload_sha256": F.when(~good, F.sha2(payload, 256)),
            "log_payload": F.when(good, payload),
        }
    )
    return preprocess_dumps(sized, F.col("max_context_lines")).withColumn("incident_key", request_key())


def accepted_of(intake: DataFrame) -> DataFrame:
    """The incidents of an intake, as ``incidents_of`` gives them."""
    return intake.filter(F.size("errors") == 0)


def chains_of(attempts: DataFrame, agents: list[str] | None = None, limit: int = ATTEMPTS) -> DataFrame:
    """Chains of the agents named, all four by default; other agents' answers are not parsed.

    ``limit`` is the number of attempts that ``run_agents`` was given, here and below.
    """
    agents = agents or CHAIN
    return agent_chains(read_answers(attempts, agents), attempts=limit, agents=agents)


def with_upstream(incidents: DataFrame, chains: DataFrame, agents: list[str]) -> DataFrame:
    """Incidents whose named agents have all answered, with what later prompts quote."""
    for agent in agents:
        chains = chains.filter(F.col(agent).isNotNull())
    quoted = [F.col(QUOTED[name]).alias(name) for name in QUOTED if QUOTED[name].split(".")[0] in agents]
    upstream = chains.select(F.col("incident_id").alias("request_id"), *quoted)
    return incidents.join(upstream, "request_id")


def prompts_for(asked: DataFrame, agent: str) -> DataFrame:
    """incident_id, agent and prompt for anchored incidents that have what the agent's prompt quotes."""
    upstream = {name: F.col(name) for name in QUOTED}
    prompt = {
        "severity": lambda: prompts.severity_prompt(),
        "diagnostic": lambda: prompts.diagnostic_prompt(upstream["agent_severity"]),
        "remediation": lambda: prompts.remediation_prompt(upstream["root_cause"], upstream["explanation"]),
        "postmortem": lambda: prompts.postmortem_prompt(*upstream.values()),
    }[agent]()
    return asked.select(F.col("request_id").alias("incident_id"), F.lit(agent).alias("agent"), prompt.alias("prompt"))


def prompts_of(
    incidents: DataFrame, agent: str, attempts: DataFrame | None, limit: int = ATTEMPTS
) -> DataFrame:
    """incident_id, agent and prompt for the anchored incidents an agent can be asked about.

    ``attempts`` holds the earlier agents' attempts; the first agent needs none.
    """
    earlier = CHAIN[: CHAIN.index(agent)]
    asked = incidents.filter(has_anchor())
    if earlier:
        asked = with_upstream(asked, chains_of(attempts, earlier, limit), earlier)
    return prompts_for(asked, agent)


def run_agents(
    incidents: DataFrame,
    model: Model,
    folder: str,
    fallback: Model | None = None,
    attempts: int = ATTEMPTS,
    batch: int = 256,
    concurrency: int | None = None,
) -> DataFrame:
    """Ask the four agents one after the other; returns the attempts table.

    Dumps are searched once: the anchored incidents are written below ``folder``
    before the first agent, as are every agent's chosen answers, which the next
    prompts quote, and every attempt, a table of its own.  Replies go to a
    journal first (``tocsin.operators.agents.ask_once``), so a run that was
    broken off goes on where it ended when it is started again with the same
    folder, and a finished one asks nothing; prompts that have changed are asked.

    An answer that breaks its agent's rules is asked for again, up to ``attempts`` times, as
    is one whose failure is worth another attempt.  An agent is asked only about
    incidents that all earlier agents have answered.  ``batch`` prompts go into a call, at
    most ``concurrency`` calls run at once.  The driver takes at most four times
    ``attempts`` steps, however many incidents there are.
    """
    spark, done = incidents.sparkSession, None

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    asked = written(incidents.filter(has_anchor()), "incidents")
    for agent in CHAIN:
        waiting, own = prompts_for(asked, agent), None
        for number in range(1, attempts + 1):
            step = f"agent={agent}/attempt={number}"
            waiting = written(waiting, f"asked/{step}")
            told = ask_once(waiting, model, f"{folder}/journal/{step}", fallback, number, batch, concurrency)
            tried = written(told, step)
            own = tried if own is None else own.unionByName(tried)
            again = read_answers(tried, [agent]).filter(F.size("errors") > 0).filter(worth_another())
            waiting = again.select("incident_id", "agent", "prompt")
        done = own if done is None else done.unionByName(own)
        chosen = written(chains_of(own, [agent], attempts), f"chosen/agent={agent}")
        asked = with_upstream(asked, chosen, [agent])
    return done


def usage_of(attempts: DataFrame, limit: int = ATTEMPTS) -> DataFrame:
    return chain_usage(read_answers(attempts, CHAIN), attempts=limit)


def reports_of(requests: DataFrame, attempts: DataFrame, rules: Rules, limit: int = ATTEMPTS) -> DataFrame:
    return all_reports(incidents_of(requests), chains_of(attempts, limit=limit), rules)


def anchored_of(incidents: DataFrame) -> DataFrame:
    """Key columns of the incidents the agents are asked about."""
    return incidents.filter(has_anchor()).select(
        F.col("request_id").alias("incident_id"), "service_name", "incident_key"
    )


def dead_letters_of(requests: DataFrame, attempts: DataFrame, limit: int = ATTEMPTS) -> DataFrame:
    return unavailable(anchored_of(incidents_of(requests)), usage_of(attempts, limit))
