"""Plan shapes shared by operators: chunked scans, salted joins, scratch space."""
