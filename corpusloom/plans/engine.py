"""The engine: passes that build and maintain the index, and the queries over it. All results are DataFrames or counts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import config, models, obs, schema
from corpusloom.functions import expr as E
from corpusloom.operators import relational as R
from corpusloom.operators import tree
from corpusloom.operators.snapshot import Store
from corpusloom.plans import prompts
from corpusloom.sources import files as S

KEY = ["repo", "path", "kind", "symbol"]
COLUMNS = [f.name for f in schema.FRAGMENT.fields]
GUIDE = "AGENTS.md"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder of spark.checkpoint.dir, or in one of our own where that is unset."""
    context = df.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().isDefined()):
        import tempfile

        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint()


class Engine:
    def __init__(self, spark: SparkSession, settings: config.Settings | None = None, embedder=None, analyser=None):
        self.spark = spark
        self.settings = settings or config.load()
        self.store = Store(spark, self.settings.store)
        self.embedder = embedder or models.HashingEmbedder(self.settings.dim)
        self.notes_model = analyser or models.analyser(self.settings.notes_model)
        self.rollup_model = analyser or models.analyser(self.settings.rollup_model)

    # -- model calls -----------------------------------------------------------------------------------------------

    def embedded(self, df: DataFrame, text: str) -> DataFrame:
        """df with `embedding` of a column, in batches of settings.batch texts, in Python workers."""
        model, size = self.embedder, self.settings.batch
        out = T.StructType([f for f in df.schema.fields if f.name != "embedding"] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
        names = [f.name for f in df.schema.fields if f.name != "embedding"]

        def run(batches):
            for pdf in batches:
                texts, vectors = pdf[text].tolist(), []
                for i in range(0, len(texts), size):
                    vectors += models.embed(model, texts[i : i + size])
                yield pdf.assign(embedding=vectors)

        return df.select(names).mapInPandas(run, out)

    @staticmethod
    def generated(df: DataFrame, model, prompt: str = "prompt") -> DataFrame:
        """df with `body`, the model's answer; rows without an answer go."""
        out = T.StructType([*df.schema.fields, T.StructField("body", T.StringType())])

        def run(batches):
            for pdf in batches:
                yield pdf.assign(body=[models.generate(model, p, prompts.SYSTEM) for p in pdf[prompt]])

        return df.mapInPandas(run, out).where("body <> ''")

    def _upsert(self, repo: str, batch: DataFrame, existing: DataFrame) -> DataFrame:
        """The repository's fragments with the batch's, which gets ids, vectors and times. Each text goes to the model once: what comes back is kept."""
        rows = checkpointed(self.embedded(batch.withColumn("id", E.fragment_id("repo", "path", "kind", "symbol")).withColumn("updated_at", F.current_timestamp()), "content"))
        return R.upsert(existing, rows.select(COLUMNS), KEY)

    # -- code ------------------------------------------------------------------------------------------------------

    def index_repo(self, repo_path: str, repo: str | None = None, subpath: str | None = None, include_tests: bool = False, prune: bool = False) -> dict[str, int]:
        """Parses the sources, embeds what changed, rebuilds the graph. prune: fragments that the scan no longer has go."""
        repo = repo or Path(repo_path).name
        with obs.timed("index", repo=repo) as told:
            parsed = checkpointed(S.parsed_java(S.java_files(self.spark, repo_path, subpath, include_tests)))
            facts = parsed.select("path", F.explode("fragments").alias("f")).select(F.lit(repo).alias("repo"), "path", "f.*")
            facts = facts.withColumns({"lang": F.lit("java"), "source": F.lit("facts"), "content_hash": E.content_hash("content")})
            # overloads share a symbol: the last in the file stands for them, before hashes are compared
            facts = R.last_write(facts, KEY, "line_start", "content_hash")
            existing = checkpointed(self.store.read("fragment", repo))
            todo = checkpointed(R.changed(facts, existing, KEY))
            n = todo.count()
            merged = self._upsert(repo, todo, existing)
            if prune:
                live = facts.select("repo", "path", "kind", "symbol")
                gone = existing.where(F.col("kind").isin(*schema.FACT_KINDS)).join(live, KEY, "left_anti").select("id")
                merged = merged.join(gone, "id", "left_anti")
            if n or prune:
                self.store.write("fragment", repo, merged)
            edges = self._rebuild_edges(repo, parsed)
            stats = {"files": parsed.count(), "fragments": facts.count(), "indexed": n, "edges": edges}
            told |= stats
        return stats

    def _rebuild_edges(self, repo: str, parsed: DataFrame) -> int:
        """calls, imports and contains anew; mentions stay."""
        raw = parsed.select("path", F.explode("edges").alias("e")).select("path", "e.*")
        frags = parsed.select("path", F.explode("fragments").alias("f")).select("path", "f.kind", "f.symbol")
        methods = frags.where("kind = 'method'").select("path", E.owner("symbol").alias("src_symbol"), F.col("symbol").alias("dst_symbol"))
        types = frags.where("kind = 'class'").select("path", F.col("symbol").alias("src_symbol")).distinct()
        inside = methods.join(types, ["path", "src_symbol"]).withColumn("kind", F.lit("contains"))
        wanted = raw.unionByName(inside).distinct()
        known = self.store.read("fragment", repo).where(F.col("kind").isin(*schema.FACT_KINDS)).select("id", "path", "symbol", "kind")
        # only code may be an end: a note of the same class has the same path and symbol
        ends = known.groupBy("path", "symbol").agg(F.min_by("id", "kind").alias("id"))
        src = wanted.join(ends.select("path", F.col("symbol").alias("src_symbol"), F.col("id").alias("src_id")), ["path", "src_symbol"])
        dst = src.join(ends.select("path", F.col("symbol").alias("dst_symbol"), F.col("id").alias("found"), F.lit("contains").alias("kind")), ["path", "dst_symbol", "kind"], "left")
        fresh = dst.select(F.lit(repo).alias("repo"), "src_id", F.col("found").alias("dst_id"), F.when(F.col("found").isNull(), F.col("dst_symbol")).alias("dst_symbol"), "kind").dropDuplicates()
        old = self.store.read("edge", repo).where("kind = 'mentions'")
        every = checkpointed(fresh.unionByName(R.cascade(old, self.store.read("fragment", repo))))
        self.store.write("edge", repo, every)
        return every.where("kind <> 'mentions'").count()

    # -- documents -------------------------------------------------------------------------------------------------

    def ingest_docs(self, docs_path: str, repo: str | None = None) -> dict[str, int]:
        """Parses documents to sections, embeds what changed, prunes sections that their document no longer has, links."""
        repo = repo or Path(docs_path).name
        with obs.timed("ingest", repo=repo) as told:
            parsed = checkpointed(S.parsed_documents(S.document_files(self.spark, docs_path), self.settings.max_chars))
            self._archive(parsed, docs_path)
            stats = self.ingest_parsed(parsed, repo)
            told |= stats
        return stats

    def ingest_parsed(self, parsed: DataFrame, repo: str) -> dict[str, int]:
        """The same over parsed documents (path, sections, error), wherever they come from."""
        good = parsed.where("sections IS NOT NULL")
        rows = good.select("path", F.posexplode("sections").alias("place", "s")).select(
            F.lit(repo).alias("repo"), "path", F.lit("doc").alias("kind"), "s.symbol", F.array_join("s.heading_path", " / ").alias("signature"),
            F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit("html").alias("lang"), F.lit("docs").alias("source"),
            F.col("s.text").alias("content"), E.content_hash("s.text").alias("content_hash"), "place",
        )
        n_sections = rows.count()
        docs = checkpointed(R.last_write(rows, KEY, "place").drop("place"))
        existing = checkpointed(self.store.read("fragment", repo))
        todo = checkpointed(R.changed(docs, existing, KEY))
        n = todo.count()
        merged = self._upsert(repo, todo, existing)
        own, rest = merged.where("kind = 'doc'"), merged.where("kind <> 'doc'")
        live = docs.select("path", "symbol").unionByName(good.select("path", F.lit(None).cast("string").alias("symbol")))
        self.store.write("fragment", repo, rest.unionByName(R.pruned(own, live, ["path"], ["symbol"])))
        links = self.link_docs(repo)["links"]
        return {"files": parsed.count(), "sections": n_sections, "ingested": n, "skipped": parsed.where("sections IS NULL").count(), "collisions": n_sections - docs.count(), "links": links}

    def _archive(self, parsed: DataFrame, docs_path: str) -> None:
        """Converted markdown beside the documents; a failure is told, and ends nothing."""
        root = Path(self.settings.docs_md_root or f"{docs_path}/{S.OWN}/md")
        for r in parsed.where("markdown IS NOT NULL").select("path", "markdown").toLocalIterator():
            at = (root / r.path).with_suffix(".md")
            try:
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(r.markdown, encoding="utf-8")
            except OSError as e:
                obs.event("archive", outcome="error", error=type(e).__name__)

    def link_docs(self, repo: str) -> dict[str, int]:
        """mentions edges anew: sections that name a class of the repository."""
        every = self.store.read("fragment", repo)
        docs = every.where("kind = 'doc'").select("id", "repo", "content")
        classes = every.where("kind = 'class' AND symbol IS NOT NULL").select("id", "repo", "symbol")
        fresh = R.mention_edges(docs, classes).select(F.lit(repo).alias("repo"), "src_id", "dst_id", F.lit(None).cast("string").alias("dst_symbol"), F.lit("mentions").alias("kind"))
        fresh = checkpointed(fresh)
        old = R.cascade(self.store.read("edge", repo).where("kind <> 'mentions'"), every)
        self.store.write("edge", repo, checkpointed(old.unionByName(fresh)))
        return {"docs": docs.count(), "linked_docs": fresh.select("src_id").distinct().count(), "classes": classes.count(), "links": fresh.count()}

    # -- notes -----------------------------------------------------------------------------------------------------

    def class_units(self, parsed: DataFrame) -> DataFrame:
        """path, symbol, signature, line_start, line_end, trivial, signatures, bodies, fields of each type; of types with one name in a file the last."""
        frags = parsed.select("path", F.explode("fragments").alias("f")).select("path", "f.*")
        types = R.last_write(frags.where("kind = 'class'"), ["path", "symbol"], "line_start").withColumn("type", E.simple_name("symbol"))
        methods = frags.where("kind = 'method'").select("path", E.owner("symbol").alias("owner"), F.col("symbol").alias("method"), F.col("signature").alias("m_signature"), "content", F.col("line_start").alias("at"))
        fine = ~E.is_ctor("method", "owner") & ~E.is_boilerplate("method", "m_signature", "content", self.settings.compat_accessors)
        mine = methods.where(fine).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "m_signature", "content"))).alias("m"))
        fields = parsed.select("path", F.explode("fields").alias("type", "fields"))
        unit = types.drop("content").join(mine.withColumnRenamed("owner", "symbol"), ["path", "symbol"], "left").join(fields, ["path", "type"], "left")
        none = F.array().cast("array<string>")
        return unit.select(
            "path", "symbol", "signature", "line_start", "line_end", (E.is_record("signature") | F.col("m").isNull()).alias("trivial"),
            F.coalesce(F.transform("m", lambda x: x["m_signature"]), none).alias("signatures"), F.coalesce(F.transform("m", lambda x: x["content"]), none).alias("bodies"), F.coalesce("fields", none).alias("fields"),
        )

    def leaf_prompt(self):
        if self.settings.include_bodies:
            return prompts.leaf_bodies(F.col("signature"), F.col("path"), F.col("fields"), F.col("bodies"))
        return prompts.leaf(F.col("signature"), F.col("path"), F.col("signatures"))

    def note_key(self):
        facts = F.concat(F.array_sort("bodies"), F.array_sort("fields")) if self.settings.include_bodies else F.col("signatures")
        head = F.concat_ws("\n", F.lit(f"model={self.settings.notes_model}"), F.lit(f"bodies={self.settings.include_bodies}"), "signature")
        return E.content_hash(F.concat_ws("\n", head, facts)) if self.settings.include_bodies else E.content_hash(E.facts_key(F.lit(self.settings.notes_model), F.lit("False"), F.col("signature"), facts))

    def enrich_repo(self, repo_path: str, repo: str | None = None, subpath: str | None = None, include_tests: bool = False) -> dict[str, int]:
        """Notes on classes that aren't trivial, made anew where what they depend on has changed."""
        repo = repo or Path(repo_path).name
        with obs.timed("enrich", repo=repo) as told:
            parsed = checkpointed(S.parsed_java(S.java_files(self.spark, repo_path, subpath, include_tests)))
            units = checkpointed(self.class_units(parsed))
            good = units.where("NOT trivial").withColumns({"repo": F.lit(repo), "kind": F.lit("note"), "content_hash": self.note_key(), "prompt": self.leaf_prompt()})
            existing = checkpointed(self.store.read("fragment", repo))
            todo = R.changed(good.select("repo", "path", "kind", "symbol", "signature", "line_start", "line_end", "content_hash", "prompt"), existing, KEY)
            made = checkpointed(self.generated(todo, self.notes_model))
            root = Path(self.settings.notes_root or f"{repo_path}/{S.OWN}/notes")
            md = E.leaf_markdown("symbol", "path", "line_start", "signature", "body")
            self._write_notes(made.select(F.concat(F.regexp_replace("path", r"\.java$", ""), F.lit("/"), "symbol", F.lit(".md")).alias("at"), md.alias("text")), root)
            notes = made.withColumns({"content": F.col("body"), "lang": F.lit("java"), "source": F.lit("llm")}).drop("body", "prompt")
            merged = self._upsert(repo, notes, existing)
            own, rest = merged.where("kind = 'note'"), merged.where("kind <> 'note'")
            live = good.select("path", "symbol").unionByName(parsed.select("path", F.lit(None).cast("string").alias("symbol")))
            self.store.write("fragment", repo, rest.unionByName(R.pruned(own, live, ["path"], ["symbol"])))
            counted = units.agg(F.count("*").alias("classes"), F.count_if("trivial").alias("trivial")).first()
            noted = made.count()
            stats = {"classes": counted.classes, "trivial": counted.trivial, "noted": noted, "skipped": counted.classes - counted.trivial - noted}
            told |= stats
        return stats

    @staticmethod
    def _write_notes(rows: DataFrame, root: Path) -> None:
        for r in rows.toLocalIterator():
            at = root / r.at
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(r.text, encoding="utf-8")

    def rollup_repo(self, repo_path: str, repo: str | None = None) -> dict[str, int]:
        """Notes on directories, from the deepest up; one whose inputs haven't changed keeps its note, which its parent then sees.

        The levels are a loop, as each needs the level below; a level is one join and one aggregation over its directories.
        """
        repo = repo or Path(repo_path).name
        with obs.timed("rollup", repo=repo) as told:
            existing = checkpointed(self.store.read("fragment", repo))
            leaves = existing.where("kind = 'note'").select(E.parent_dir("path").alias("dir"), F.col("symbol").alias("name"), F.col("content").alias("body"))
            dirs = tree.directories(leaves)
            markers = [(d,) for d in self._module_dirs(repo_path)]
            kept = tree.collapsed(dirs, self.spark.createDataFrame(markers, "dir string")).withColumn("kind", E.dir_kind("dir", "is_module")).withColumn("depth", E.depth("dir"))
            kept = checkpointed(kept)
            known = existing.where(F.col("kind").isin(*schema.ROLLUP_KINDS)).select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("dir"), F.col("kind").alias("old_kind"), "content", "content_hash")
            own = leaves.select("dir", F.lit("class").alias("kind"), "name", "body")
            done = self.spark.createDataFrame([], "dir string, parent string, kind string, body string, digest string, fresh boolean")
            for r in kept.select("depth").distinct().orderBy(F.desc("depth")).collect():
                below = done.where("parent IS NOT NULL").select(F.col("parent").alias("dir"), "kind", F.col("dir").alias("name"), "body")
                here = kept.where(F.col("depth") == r.depth)
                parts = own.unionByName(below).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "body"))).alias("children"))
                level = here.select("dir", "parent", "kind").join(parts, "dir").withColumn("digest", E.inputs_digest(F.lit(self.settings.rollup_model), "children"))
                seen = level.join(known, "dir", "left")
                same = F.coalesce((F.col("content_hash") == F.col("digest")) & (F.col("old_kind") == F.col("kind")), F.lit(False))
                old = seen.where(same).select("dir", "parent", "kind", F.col("content").alias("body"), "digest", F.lit(False).alias("fresh"))
                ask = seen.where(~same).select("dir", "parent", "kind", "digest", prompts.rollup(F.col("dir"), F.col("kind"), F.col("children")).alias("prompt"))
                new = self.generated(ask, self.rollup_model).select("dir", "parent", "kind", "body", "digest", F.lit(True).alias("fresh"))
                done = checkpointed(done.unionByName(old).unionByName(new))
            root = Path(self.settings.notes_root or f"{repo_path}/{S.OWN}/notes")
            self._write_notes(done.where("fresh").select(F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit("_index.md")).alias("at"), E.rollup_markdown("dir", "kind", "body").alias("text")), root)
            live = {r.dir for r in done.select("dir").toLocalIterator()}
            pruned_md = 0
            for at in root.rglob("_index.md") if root.is_dir() else ():
                if ("" if at.parent == root else at.parent.relative_to(root).as_posix()) not in live:
                    at.unlink()
                    pruned_md += 1
            path = F.when(F.col("dir") == "", ".").otherwise(F.col("dir"))
            rows = done.where("fresh").select(
                F.lit(repo).alias("repo"), path.alias("path"), "kind", F.when(F.col("dir") == "", repo).otherwise(F.col("dir")).alias("symbol"), F.lit(None).cast("string").alias("signature"),
                F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit("java").alias("lang"), F.lit("llm").alias("source"), F.col("body").alias("content"), F.col("digest").alias("content_hash"),
            )
            merged = self._upsert(repo, rows, existing)
            is_rollup = F.col("kind").isin(*schema.ROLLUP_KINDS)
            own_rows = merged.where(is_rollup).join(done.select(path.alias("path"), "kind"), ["path", "kind"], "left_semi").select(COLUMNS)
            self.store.write("fragment", repo, merged.where(~is_rollup).unionByName(own_rows))
            counts = {r.kind: r["count"] for r in done.groupBy("kind").count().collect()}
            rolled = done.where("fresh").count()
            stats = {"directories": counts.get("directory", 0), "modules": counts.get("module", 0), "projects": counts.get("project", 0), "rolled": rolled, "skipped": len(live) - rolled, "pruned_md": pruned_md}
            told |= stats
        return stats

    def _module_dirs(self, repo_path: str) -> list[str]:
        """Directories with a build file."""
        root = Path(repo_path)
        found = {p.parent.relative_to(root).as_posix() for m in self.settings.module_markers for p in root.rglob(m)}
        return sorted(d for d in found if d != ".")

    # -- queries ---------------------------------------------------------------------------------------------------

    def _fragments(self, repo: str | None) -> DataFrame:
        return R.scoped(self.store.read("fragment", repo or self.settings.repo or None), repo, self.settings.repo)

    def _edges(self, repo: str | None) -> DataFrame:
        return R.scoped(self.store.read("edge", repo or self.settings.repo or None), repo, self.settings.repo)

    def _query_vector(self, query: str) -> list[float]:
        return models.embed(self.embedder, [query])[0]

    def search_code(self, query: str, limit: int = 10, repo: str | None = None) -> DataFrame:
        """Fragments nearest to the query, documents left out, the nearest first."""
        found = R.nearest(self._fragments(repo).where("source <> 'docs'"), self._query_vector(query), limit, "repo", "path", "kind", "symbol")
        return found.select(*schema.RESULT_COLUMNS)

    def get_file(self, path: str, line_start: int | None = None, line_end: int | None = None, repo: str | None = None) -> DataFrame:
        """The smallest fragment over a line, or the file's first; facts before notes. FileNotFoundError where there is none."""
        here = self._fragments(repo).where(F.col("path") == path).withColumn("_rank", F.when(F.col("source") == "facts", 0).otherwise(1))
        found = R.covering_span(here, line_start, ["path"], "_rank", "kind", "symbol", "repo").select(*schema.RESULT_COLUMNS)
        if not found.take(1):
            raise FileNotFoundError(path)
        return found

    def find_usages(self, symbol: str, limit: int = 50, repo: str | None = None) -> DataFrame:
        return R.usages(self._edges(repo), self._fragments(repo), symbol, limit)

    def get_deps(self, symbol: str, limit: int = 50, repo: str | None = None) -> DataFrame:
        order = ("path", "symbol", *[c for c in schema.RESULT_COLUMNS if c not in ("path", "symbol")])
        return R.dependencies(self._edges(repo), self._fragments(repo), symbol, limit, order).select(*schema.RESULT_COLUMNS)

    def _docs(self, rows: DataFrame, repo: str | None) -> DataFrame:
        """Rows of sections as results, with the classes each mentions."""
        classes = self._fragments(repo).where("kind = 'class'").select("id", "symbol")
        named = R.mentions_by_doc(self._edges(repo).where("kind = 'mentions'"), classes)
        joined = rows.join(named, rows["id"] == named["src_id"], "left")
        return joined.select(
            "repo", F.col("path").alias("document"), E.heading_of("signature", "symbol").alias("heading_path"), "symbol", "content", F.lit("docs").alias("source"), F.lit("untrusted").alias("trust"),
            F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"), "tier", "rank",
        ).orderBy("tier", "rank")

    def _near_docs(self, query: str, limit: int, repo: str | None) -> DataFrame:
        near = R.nearest(self._fragments(repo).where("kind = 'doc'"), self._query_vector(query), limit, "repo", "path", "symbol")
        return near.withColumn("rank", F.struct(F.coalesce("distance", F.lit(float("inf"))).alias("d"), F.concat_ws("\t", "repo", "path", "symbol").alias("k")))

    def search_docs(self, query: str, limit: int = 10, repo: str | None = None) -> DataFrame:
        return self._docs(self._near_docs(query, limit, repo).withColumn("tier", F.lit(0)), repo).drop("tier", "rank")

    def find_convention(self, query: str, limit: int = 10, symbol: str | None = None, repo: str | None = None) -> DataFrame:
        """Sections linked to the symbol's class, then those nearest to the query that aren't among them; `limit` in all, and of each kind."""
        near = self._near_docs(query, limit, repo)
        if not symbol:
            return self._docs(near.withColumn("tier", F.lit(0)), repo).drop("tier", "rank")
        every = self._fragments(repo)
        classes = every.where((F.col("kind") == "class") & (F.col("symbol") == symbol.rsplit(".", 1)[-1])).select(F.col("id").alias("dst_id"))
        linked = self._edges(repo).where("kind = 'mentions'").join(classes, "dst_id").select(F.col("src_id").alias("id")).distinct()
        first = every.where("kind = 'doc'").join(linked, "id").orderBy("path", "symbol").limit(limit)
        first = first.withColumn("rank", F.struct(F.lit(0.0).alias("d"), F.concat_ws("\t", "path", "symbol", "repo").alias("k")))
        both = R.tiered(first, near.drop("distance"), ["path", "symbol"], ["rank"], limit)
        return self._docs(both, repo).drop("tier", "rank")

    def module_map(self, repo: str, limit: int = 40) -> DataFrame:
        return R.area_counts(self.store.read("fragment", repo), limit)

    def write_starter(self, repo_path: str, repo: str | None = None, *, force: bool = False) -> dict:
        """A guide file with the repository's areas, to be filled in by hand; one that is there stays unless force."""
        root = Path(repo_path)
        if not root.is_dir():
            raise NotADirectoryError(repo_path)
        at, repo = root / GUIDE, repo or root.name
        if at.exists() and not force:
            return {"path": str(at), "modules": 0, "written": False}
        try:
            areas = [(r.area, r.n) for r in self.module_map(repo).collect()]
        except Exception as e:  # without an index the guide is still worth having
            obs.event("starter", repo=repo, outcome="no_map", error=type(e).__name__)
            areas = []
        listed = "".join(f"- `{a}/`: {n} fragments. TODO: what lives here.\n" for a, n in areas)
        head = f"{sum(n for _, n in areas)} fragments in {len(areas)} areas:\n\n" if areas else "This repository is not indexed yet; run `index` and write this file again.\n"
        at.write_text(f"# {repo}: guide for assistants\n\n## Areas\n\n{head}{listed}\n## Conventions\n\nTODO: build and test commands, style, what not to touch.\n", encoding="utf-8")
        return {"path": str(at), "modules": len(areas), "written": True}

    def sync_space(self, space: str, dest_path: str, rows: list[tuple] | None = None) -> dict[str, int]:
        from corpusloom.sources import wiki

        s = self.settings
        if rows is None:
            self.spark.dataSource.register(wiki.WikiSource)
            return wiki.sync_space(self.spark, space, dest_path, None, url=s.wiki_url, token=s.wiki_token, email=s.wiki_email, size=str(s.wiki_page_size), body=s.wiki_format)
        return wiki.sync_space(self.spark, space, dest_path, rows)

    def table_counts(self) -> dict[str, int]:
        return {t: self.store.read(t).count() for t in self.store.shapes}


