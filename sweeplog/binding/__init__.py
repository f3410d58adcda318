"""Driver tables seen as case files, run logs and reports, with one query per operator and its SQL twin."""
