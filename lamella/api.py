"""The engine behind the interface: each entry point as a method that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella import __version__
from lamella.common import cut, folder_exists
from lamella.model.reference import ReferenceModel
from lamella.operators import analysis, ledger, pairing, store
from lamella.raster.plates import FEATURES
from lamella.sources import ledgers

LEDGERS = {
    "scores": ledgers.PLATE_SCORES,
    "features": ledgers.PLATE_FEATURES,
    "pairs": ledgers.PAIR_SCORES,
    "index": ledgers.EMBEDDING_INDEX,
    "fused": ledgers.FUSED_SCORES,
    "pair_embeddings": ledgers.PAIR_EMBEDDING_SCORES,
}


def _at_edge(df: DataFrame, *columns: str) -> DataFrame:
    """What the interface adds to a stored row: ``saved_at`` and ``report_url``."""
    return df.select(*(columns or ("exam_id",)), F.col("created_at").alias("saved_at"), F.concat(F.lit("/reports/"), "exam_id").alias("report_url"))


class Engine:
    """``paths`` names ledger files by the keys of ``LEDGERS``, and optionally ``manifest``; ``exams`` is the store's table."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], exams: str = "exams", pictures: str | None = None, model: str | None = None):
        """``pictures``: a shared folder for the pictures of analyses; ``model``: where the fitted model is stored, or will be."""
        self.spark, self.paths, self.exams, self.pictures, self.stored = spark, paths, exams, pictures, model
        self._model: ReferenceModel | None = None

    def _ledger(self, name: str) -> DataFrame:
        return ledgers.read_ledger(self.spark, self.paths[name], LEDGERS[name])

    def health(self) -> DataFrame:
        row = self.spark.range(1)
        return row.select(F.lit("ok").alias("status"), F.lit(__version__).alias("version"), F.lit("NONE").alias("clinical_claim"))

    def model_info(self) -> DataFrame:
        return ledgers.read_document(self.spark, self.paths["manifest"])

    def reference_plates(self) -> DataFrame:
        """Scored plates, the most unusual first."""
        fused = self._ledger("fused") if "fused" in self.paths else None
        out = ledger.reference_plates(self._ledger("scores"), self._ledger("features"), self._ledger("index"), fused=fused)
        return out.orderBy(F.desc("reference_anomaly_score_0_1"), "plate_id")

    def reference_embeddings(self) -> tuple[DataFrame, DataFrame]:
        """Embedding scores of plates and of pairs; infinities pass here."""
        return ledger.cleaned(self._ledger("index"), True), ledger.cleaned(self._ledger("pair_embeddings"), True)

    def reference_pairs(self) -> DataFrame:
        return ledger.pair_records(self._ledger("pairs")).orderBy(F.desc("reference_pair_anomaly_score_0_1"), "bilateral_pair_id")

    def model(self) -> ReferenceModel:
        """The model of the feature ledger: the stored one if there is one, else fitted once, and stored if a place is named."""
        if self._model is None and self.stored and folder_exists(self.spark, self.stored):
            self._model = ReferenceModel.load(self.spark, self.stored)
        if self._model is None:
            self._model = ReferenceModel.fit(self._ledger("features"), "plate_id", list(FEATURES))
            if self.stored:
                self._model.save(self.spark, self.stored)
        return self._model

    def analyze_exam(self, image_dir: str, metadata_json: str | None, exam_id: str) -> DataFrame:
        """Analyze the images of a folder and save the result; returns the analyzed document."""
        if not analysis.is_exam_id(exam_id):
            raise ValueError("an examination's id has letters, digits, dots, dashes and underscores only")
        images = ledgers.read_images(self.spark, image_dir)
        if images.isEmpty():
            raise ValueError("no files")
        metadata = self.spark.createDataFrame([(metadata_json or "[]",)], "t string")
        if metadata_json and metadata.where(analysis.S.upload_items(F.col("t")).isNull()).count():
            raise ValueError("metadata is neither a list nor an object with files")
        out = cut(analysis.analyze_exam(images, metadata, "t", exam_id, self.model(), pictures=self.pictures))
        store.create_table(self.spark, self.exams)
        row = cut(analysis.stored_row(out))
        store.save(row, self.exams)
        at_edge = _at_edge(row)  # of the row just saved, not analysed again
        return out.join(F.broadcast(at_edge), "exam_id").select("exam_id", "document", "saved_at", "report_url")

    def upload_lookup(self, metadata: DataFrame, text: str) -> DataFrame:
        return pairing.upload_lookup(metadata, text)

    def list_exams(self, limit: int = 50) -> DataFrame:
        latest = store.current(self.spark.table(self.exams).select(*store.HISTORY))
        return store.history(latest, [F.desc("created_at"), "exam_id"], list(store.HISTORY), limit)

    def get_exam(self, exam_id: str) -> DataFrame:
        """The latest document of an examination, when it was saved and where its report is; no row if there is none."""
        found = store.parsed(store.current(store.detail(self.spark.table(self.exams), "exam_id", exam_id)))
        return _at_edge(found, *found.columns)

    def report_html(self, exam_id: str) -> DataFrame:
        return self.get_exam(exam_id).select("exam_id", store.report_html(F.col("document")).alias("html"))
