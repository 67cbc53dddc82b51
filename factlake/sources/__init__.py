"""Where result sets live: the snapshot log, tables and connection settings."""
