"""gazeloom: Spark jobs for a notice and article corpus."""
