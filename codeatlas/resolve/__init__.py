"""Import resolution as joins: from specs to file-to-file links.

Every resolver turns a spec into ordered candidate paths and keeps the first that exists.
Candidates are made for distinct specs and folders only, never per importing file.
"""
