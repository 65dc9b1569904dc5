"""Nothing streams yet: every operator of the survey works on closed files."""
