"""Training-data operators: thirteen DataFrame operators and their queries.

Nothing outside this folder imports it. Every operator takes a DataFrame and
the names of its id and text columns, keeps the columns it is given (a given
column with the name of an output column is replaced) and documents what it
does with nulls, empty texts, repeated rows and empty tables.
"""
