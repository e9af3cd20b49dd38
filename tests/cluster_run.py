"""Two executors in their own processes: correction to a file and match groups.

Run by test_cluster.py as a process of its own: cluster_run.py FOLDER SF.
"""

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from svlattice import cli
from svlattice.plans.problems import QUERIES


def main(folder: Path, tables: str) -> None:
    spark = (
        SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).parents[1])).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    head = "##fileformat=VCFv4.2\n##source=svim\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    rows = [f"chr1\t{100 + i}\tr{i}\tN\t{f'N[chr2:{500 + i}[' if i % 3 == 0 else '<DEL>'}\t9\tPASS\tSVTYPE={'BND' if i % 3 == 0 else 'DEL'};END={900 + i}\tGT\t0/1" for i in range(0, 3000, 7)]
    (folder / "in.vcf").write_text(head + "".join(f"{r}\n" for r in rows))
    assert cli.main(["correct", "-i", str(folder / "in.vcf"), "-o", str(folder / "out.svcf")]) == 0
    written = [line for line in (folder / "out.svcf").read_text().splitlines() if not line.startswith("#")]
    assert len(written) == len(rows), (len(written), len(rows))
    groups = QUERIES["p5_found"](spark, tables)
    assert groups.count() == spark.read.parquet(f"{tables}/svcf_event.parquet").count()
    spark.stop()
    print("cluster run done")


if __name__ == "__main__":
    main(Path(sys.argv[1]), sys.argv[2])
