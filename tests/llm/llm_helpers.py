def bag(df):
    return sorted(map(repr, df.collect()))
