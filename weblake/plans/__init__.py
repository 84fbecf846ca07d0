"""Jobs: masking, daily load, maintenance, reports."""
