"""Tracking tables: keyed appends, upserts and replacement by a log of versions, and run rows.

A table is a folder of data folders and a log. Log entry n names the data folders that make
up version n, and is created only if no entry n is there. A writer that finds its number taken
starts again from the version that was faster, so writers at the same time lose and
double nothing. Readers see the last entry and keep its files; nothing is deleted but by `vacuum`.
"""

import json
import uuid

from pyspark.sql import functions as F

LOG = "_versions"


class TableLog:
    """The log of one table: its last version, and the creation of the next one."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self.hadoop.Path(f"{path}/{LOG}")
        self.fs = self.folder.getFileSystem(self.conf)

    def last(self):
        """(number, data folders) of the last version; (0, None) before the first."""
        if not self.fs.exists(self.folder):
            return 0, None
        numbers = [int(f.getPath().getName()) for f in self.fs.listStatus(self.folder) if f.getPath().getName().isdigit()]
        return (max(numbers), self.folders(max(numbers))) if numbers else (0, None)

    def folders(self, number):
        return json.loads(self.spark.read.text(f"{self.path}/{LOG}/{number:010d}", wholetext=True).first()[0])

    def create(self, number, folders):
        """Whether this call made entry `number`: an entry that is there stays as it is."""
        self.fs.mkdirs(self.folder)
        staged, entry = (self.hadoop.Path(f"{self.path}/{LOG}/{name}") for name in (f".{uuid.uuid4().hex}", f"{number:010d}"))
        out = self.fs.create(staged, False)
        out.writeBytes(json.dumps(folders))
        out.close()
        try:
            if self.fs.getScheme() == "file":  # a rename would replace the entry here, a link does not
                nio = self.spark.sparkContext._jvm.java.nio.file
                local = [nio.Paths.get(self.fs.makeQualified(x).toUri()) for x in (entry, staged)]
                nio.Files.createLink(*local)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
                self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(staged, entry, none)
            return True
        except Exception:
            if not self.fs.exists(entry):
                raise
            return False
        finally:
            self.fs.delete(staged, False)

    def read(self, folders):
        return self.spark.read.parquet(*[f"{self.path}/{name}" for name in folders])

    def write(self, df):
        """The name of a new data folder with these rows."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name


def _commit(spark, path, change):
    """Make the next version from the last one by `change(log, folders)`, again and again until no other writer was faster."""
    log = TableLog(spark, path)
    while True:
        number, folders = log.last()
        wanted = change(log, folders)
        if wanted == folders or log.create(number + 1, wanted):
            return log.read(wanted)


def read_table(spark, path):
    """The last version of a table."""
    log = TableLog(spark, path)
    return log.read(log.last()[1])


def new_rows(old, rows, key):
    """Rows whose key the table does not have yet, one per key."""
    return rows.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")


def append_new(spark, path, rows, key):
    """Append only rows with new keys; running it twice leaves the table unchanged."""
    def change(log, folders):
        if folders is None:
            return [log.write(rows.dropDuplicates(list(key)))]
        name = log.write(new_rows(log.read(folders), rows, key))
        added = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
        return [*folders, name] if added.take(1) else folders

    return _commit(spark, path, change)


def upserted(old, rows, key):
    """The table with rows of the same key replaced."""
    return old.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def upsert(spark, path, rows, key):
    """Replace rows by key, or add them."""
    return _commit(spark, path, lambda log, folders: [log.write(rows if folders is None else upserted(log.read(folders), rows, key))])


def replace_table(spark, df, path):
    """Replace all rows. Readers find the old version or the new one at any moment."""
    name = []

    def change(log, folders):
        if not name:  # the rows do not depend on the version before
            name.append(log.write(df))
        return [name[0]]

    return _commit(spark, path, change)


def vacuum(spark, path, keep=2):
    """Delete the data folders that older versions name and the last `keep` ones do not. Folders that no version names yet stay."""
    log = TableLog(spark, path)
    last, _ = log.last()
    live = {f for n in range(max(1, last - keep + 1), last + 1) for f in log.folders(n)}
    gone = {f for n in range(1, last - keep + 1) for f in log.folders(n)} - live
    for name in gone:
        log.fs.delete(log.hadoop.Path(f"{path}/{name}"), True)
    return len(gone)


def validation_meta(df):
    """The ids and labels a stored score vector refers to."""
    return df.select("srch_id", "prop_id", "relevance")


def run_row(metrics, run_id, split, **extra):
    """Metric rows with their run and split."""
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), "*",
                          *[F.lit(v).alias(k) for k, v in extra.items()])


def tracker_rows(runs, anchor, best):
    """Run rows in the tracker layouts: metric with its difference to an anchor and a best run."""
    common = [F.concat(F.lit("RUN_"), F.upper("model_id")).alias("exp_id"), F.col("model_id"),
              F.col("ndcg5").alias("local_ndcg5"), (F.col("ndcg5") - F.lit(anchor)).alias("delta_vs_anchor")]
    experiments = runs.select(F.lit("experiments").alias("tracker"), *common,
                              (F.col("ndcg5") - F.lit(best)).alias("delta_vs_best"),
                              F.lit(None).cast("double").alias("recall_at_5"))
    models = runs.select(F.lit("models").alias("tracker"), *common, F.lit(None).cast("double").alias("delta_vs_best"),
                         F.col("recall5").alias("recall_at_5"))
    return experiments.unionByName(models)
