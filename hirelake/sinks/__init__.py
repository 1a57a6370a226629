"""Writers for the master, duplicate, review, report and index outputs."""
