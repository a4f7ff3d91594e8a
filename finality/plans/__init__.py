"""Reports built from readings, emissions and metric samples."""
